"""State hash, field-level diff, operation log, snapshots and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill import schemas
from hrefmill.operators.stats import operation_stats
from hrefmill.plans.ordering import last_value_before

SNAPSHOT_INTERVAL = 10
# Columns that a diff ignores: the row's identity and the stamp every change moves.
UNTRACKED = ["id", "seq", "updated_at"]
# Hex digits of the id hash that name a node on each level of the hash tree, leaves first.
TREE_LEVELS = [6, 4, 2, 0]


def link_state(links: DataFrame) -> DataFrame:
    """``id, state``: md5 over the fields that describe what happened to a link."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    fields = [
        text(F.col("id")),
        text(F.col("status")),
        text(F.to_json("tags")),
        text(F.col("is_internal")),
        text(F.col("duplicate_of")),
        text(F.col("similarity_group")),
    ]
    return links.select("id", F.md5(F.concat_ws("|", *fields)).alias("state"))


def state_hash(links: DataFrame) -> DataFrame:
    """One row: hash of the whole state, built as a tree over prefixes of the hashed id.

    A node hashes its children in order. Leaves are 16 million slots filled evenly by md5, inner
    nodes have at most 256 children, so no task or row ever holds more than a sliver of the links.
    """
    entries = link_state(links).select(
        F.md5("id").alias("node"), F.col("id").alias("place"), F.concat_ws(":", "id", "state").alias("text")
    )
    for digits in TREE_LEVELS:
        children = F.array_sort(F.collect_list(F.struct("place", "text")))
        entries = (
            entries.groupBy(F.left("node", F.lit(digits)).alias("parent"))
            .agg(F.sha2(F.array_join(children["text"], "|"), 256).alias("text"))
            .select(F.col("parent").alias("node"), F.col("parent").alias("place"), "text")
        )
    return entries.select(F.col("text").alias("state_hash"))


def _field_text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        return F.to_json(name)
    if kind == "timestamp":
        return F.unix_micros(name).cast("string")
    return F.col(name).cast("string")


def diff_links(before: DataFrame, after: DataFrame, op_seq: int | None = None) -> DataFrame:
    """Change rows: ``added`` and ``removed`` links, and one ``modified`` row per changed field."""
    tracked = [c for c in after.columns if c not in UNTRACKED]
    side = lambda df, tag: df.select(
        F.col("id").alias("link_id"), F.lit(True).alias(f"{tag}_here"), *[_field_text(df, c).alias(f"{tag}_{c}") for c in tracked]
    )
    both = side(before, "b").join(side(after, "a"), "link_id", "full_outer")

    def entry(kind: str, field: str | None, b: Column, a: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), b.alias("before"), a.alias("after")
        )

    none = F.lit(None).cast("string")
    edits = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), entry("modified", c, F.col(f"b_{c}"), F.col(f"a_{c}"))
                )
                for c in tracked
            ]
        )
    )
    rows = (
        F.when(F.col("b_here").isNull(), F.array(entry("added", None, none, none)))
        .when(F.col("a_here").isNull(), F.array(entry("removed", None, none, none)))
        .otherwise(edits)
    )
    return both.select(F.lit(op_seq).cast("bigint").alias("op_seq"), "link_id", F.inline(rows))


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row: links added, removed and modified."""
    return changes.agg(
        F.count_if(F.col("kind") == "added").alias("added"),
        F.count_if(F.col("kind") == "removed").alias("removed"),
        F.count_distinct(F.when(F.col("kind") == "modified", F.col("link_id"))).alias("modified"),
    )


def log_operation(
    kind: str,
    op_seq: int,
    before: DataFrame,
    after: DataFrame,
    job_id: str | None = None,
    at: Column | None = None,
    messages: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(operation row, change rows)`` of a transition, ready to append to both tables.

    ``messages`` are its errors and warnings (``operation_messages``), to be appended to a table of their own; the row
    counts the errors. ``counts`` are its counts where they were observed already (``stats.write_observed``).
    """
    if kind not in schemas.OPERATION_TYPES:
        raise ValueError(f"unknown operation type: {kind}")
    one = lambda df: df.withColumn("__one", F.lit(1))
    errors = None if messages is None else messages.filter("kind = 'error'")
    row = (
        one(operation_stats(before, after, errors) if counts is None else counts)
        .join(one(state_hash(before).withColumnRenamed("state_hash", "before_hash")), "__one", "left")
        .join(one(state_hash(after).withColumnRenamed("state_hash", "after_hash")), "__one", "left")
        .withColumns(
            {
                "op_seq": F.lit(op_seq).cast("bigint"),
                "id": F.md5(F.lit(f"operation-{op_seq}")),
                "type": F.lit(kind),
                "job_id": F.lit(job_id).cast("string"),
                "timestamp": F.current_timestamp() if at is None else at,
            }
        )
        .select(*schemas.OPERATIONS.fieldNames())
    )
    return row, diff_links(before, after, op_seq)


def operation_messages(op_seq: int, errors: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame | None:
    """``schemas.MESSAGES`` rows from tables with ``message`` and, if known, ``link_id``; None for neither."""
    out = None
    for kind, df in (("error", errors), ("warning", warnings)):
        if df is None:
            continue
        link = F.col("link_id") if "link_id" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(op_seq).cast("bigint").alias("op_seq"), F.lit(kind).alias("kind"), "message", link.alias("link_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def decode_messages(raw: DataFrame) -> DataFrame:
    """``schemas.MESSAGES`` rows of operations that store errors and warnings as JSON text; NULL is none."""
    listed = lambda name, kind: F.transform(
        F.coalesce(F.from_json(name, "array<struct<message:string,linkId:string>>"), F.array().cast("array<struct<message:string,linkId:string>>")),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["message"].alias("message"), m["linkId"].alias("link_id")),
    )
    return raw.select("op_seq", F.inline(F.concat(listed("errors", "error"), listed("warnings", "warning"))))


def operations_after(operations: DataFrame, target_seq: int) -> DataFrame:
    """Operations newer than a target, by log order so that equal timestamps cannot hide one."""
    return operations.filter(F.col("op_seq") > target_seq)


def operations_since(operations: DataFrame, at: Column) -> DataFrame:
    return operations.filter(F.col("timestamp") > at)


def recent_operations(operations: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return operations.orderBy(F.desc("timestamp"), F.desc("op_seq")).offset(offset).limit(limit)


def delete_operations(operations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Without the given operations, or empty when none are named."""
    if ids is None:
        return operations.filter(F.lit(False))
    return operations.join(ids.select("id"), "id", "left_anti").select(*operations.columns)


def decode_operations(raw: DataFrame) -> DataFrame:
    """Change rows from operations that store their changes as JSON text columns."""
    modified = F.from_json(
        "changes_modified", "array<struct<id:string,changes:map<string,struct<before:string,after:string>>>>"
    )
    plain = lambda name, kind: F.transform(
        F.coalesce(F.from_json(name, "array<string>"), F.array().cast("array<string>")),
        lambda i: F.struct(
            i.alias("link_id"),
            F.lit(kind).alias("kind"),
            F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("string").alias("before"),
            F.lit(None).cast("string").alias("after"),
        ),
    )
    edits = F.flatten(
        F.transform(
            modified,
            lambda m: F.transform(
                F.map_entries(m["changes"]),
                lambda e: F.struct(
                    m["id"].alias("link_id"),
                    F.lit("modified").alias("kind"),
                    e["key"].alias("field"),
                    e["value"]["before"].alias("before"),
                    e["value"]["after"].alias("after"),
                ),
            ),
        )
    )
    nothing = F.slice(plain("changes_added", "added"), 1, 0)
    rows = F.concat(plain("changes_added", "added"), plain("changes_removed", "removed"), F.coalesce(edits, nothing))
    return raw.select("op_seq", F.inline(rows))


def snapshot_due(operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: time of the latest snapshot, operations since, and whether a new one is due."""
    one = lambda df: df.withColumn("__one", F.lit(1))
    latest = one(snapshots.agg(F.max("created_at").alias("latest")))
    counted = (
        one(operations)
        .join(F.broadcast(latest), "__one", "left")
        .agg(
            F.count(F.lit(1)).alias("operations"),
            F.count_if(F.col("latest").isNull() | (F.col("timestamp") > F.col("latest"))).alias("since"),
        )
    )
    return (
        one(counted)
        .join(latest, "__one")
        .select(
            "latest",
            F.col("since").alias("operations_since"),
            (F.col("latest").isNull() | (F.col("operations") == 0) | (F.col("since") >= SNAPSHOT_INTERVAL)).alias("due"),
        )
    )


def snapshot_if_due(
    operations: DataFrame, snapshots: DataFrame, links: DataFrame, snapshot_id: str, at: Column
) -> tuple[DataFrame, DataFrame] | None:
    """What ``create_snapshot`` gives, if one is due; call it once an operation is in the log."""
    if not snapshot_due(operations, snapshots).first()["due"]:
        return None
    return create_snapshot(links, snapshot_id, at)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def create_snapshot(links: DataFrame, snapshot_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """``(snapshot row, one row per link id)``."""
    counted = links.agg(F.count(F.lit(1)).alias("link_count")).withColumn("__one", F.lit(1))
    row = counted.join(state_hash(links).withColumn("__one", F.lit(1)), "__one", "left").select(
        F.lit(snapshot_id).alias("id"),
        at.cast("timestamp").alias("created_at"),
        "link_count",
        F.col("state_hash").alias("checksum"),
    )
    return row, links.select(F.lit(snapshot_id).alias("snapshot_id"), F.col("id").alias("link_id"))


def snapshot_link_counts(snapshots: DataFrame) -> DataFrame:
    """Length of the JSON id list of snapshots stored in the compact form."""
    return snapshots.select("id", "created_at", F.json_array_length("link_ids").cast("bigint").alias("link_count"))


def snapshot_for_operations(operations: DataFrame, snapshots: DataFrame, direction: str = "newest_after") -> DataFrame:
    """Attach a snapshot to each operation.

    ``newest_after`` takes the newest of all snapshots if it is later than the operation. ``before``
    takes the last one not later, ``after`` the first one later. The latter two run as a sort of
    both tables by time with a carried value, so no join on an inequality is needed.
    """
    ops = operations.select("op_seq", F.col("timestamp").alias("at"))
    if direction == "newest_after":
        newest = snapshots.agg(F.max_by("id", F.struct("created_at", "id")).alias("snapshot_id"), F.max("created_at").alias("__at"))
        tagged = ops.withColumn("__one", F.lit(1)).join(F.broadcast(newest.withColumn("__one", F.lit(1))), "__one", "left")
        return tagged.select("op_seq", F.when(F.col("at") < F.col("__at"), F.col("snapshot_id")).alias("snapshot_id"))
    if direction not in ("before", "after"):
        raise ValueError(f"unknown direction: {direction}")
    sign = 1 if direction == "before" else -1
    timeline = ops.select(
        (F.unix_micros("at") * sign).alias("t"), F.lit(1).alias("side"), F.col("op_seq").cast("string").alias("key"),
        "op_seq", F.lit(None).cast("string").alias("snapshot_id"),
    ).unionByName(
        # At equal times a snapshot counts as before the operation, never as after it.
        snapshots.select(
            (F.unix_micros("created_at") * sign).alias("t"), F.lit(0 if sign == 1 else 2).alias("side"),
            F.col("id").alias("key"), F.lit(None).cast("bigint").alias("op_seq"), F.col("id").alias("snapshot_id"),
        )
    )
    carried = last_value_before(timeline, ["t", "side", "key"], "snapshot_id", "found")
    return carried.filter("op_seq IS NOT NULL").select("op_seq", F.col("found").alias("snapshot_id"))


def rollback(links: DataFrame, changes: DataFrame, target_seq: int) -> DataFrame:
    """Links as they were just after the target operation, from the changes of all newer ones.

    Links added since are dropped and each changed field gets the ``before`` value of the oldest
    newer change. Rows removed since cannot come back from changes alone; read an older table
    version for those.
    """
    newer = changes.filter(F.col("op_seq") > target_seq)
    added = newer.filter("kind = 'added'").select(F.col("link_id").alias("id")).distinct()
    oldest = (
        newer.filter("kind = 'modified'")
        .groupBy("link_id", "field")
        .agg(F.min_by(F.struct("before"), "op_seq").alias("old"))
    )
    # At most one entry per tracked column.
    undo = oldest.groupBy(F.col("link_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "old"))).alias("__undo")
    )
    kept = links.join(added, "id", "left_anti").join(undo, "id", "left")
    tracked = [c for c in links.columns if c not in UNTRACKED]

    def restored(name: str) -> Column:
        text = F.try_element_at("__undo", F.lit(name))["before"]
        kind = dict(links.dtypes)[name]
        if kind.startswith("array"):
            value = F.from_json(text, kind)
        elif kind == "timestamp":
            value = F.timestamp_micros(text.cast("bigint"))
        else:
            value = text.cast(kind)
        return F.when(F.array_contains(F.map_keys("__undo"), name), value).otherwise(F.col(name))

    moved = F.when(F.col("__undo").isNotNull(), F.current_timestamp()).otherwise(F.col("updated_at"))
    return kept.withColumns({**{c: restored(c) for c in tracked}, "updated_at": moved}).select(*links.columns)


def rollback_to(
    links: DataFrame, operations: DataFrame, changes: DataFrame, target_seq: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(links, operations, changes)`` after undoing everything newer than the target operation.

    Fails when the target is missing or nothing is newer. Log the result with ``log_operation``.
    """
    found = operations.agg(
        F.count_if(F.col("op_seq") == target_seq).alias("target"), F.count_if(F.col("op_seq") > target_seq).alias("newer")
    ).first()
    if not found["target"]:
        raise ValueError(f"operation {target_seq} not found")
    if not found["newer"]:
        raise ValueError(f"nothing is newer than operation {target_seq}")
    return (
        rollback(links, changes, target_seq),
        operations.filter(F.col("op_seq") <= target_seq),
        changes.filter(F.col("op_seq") <= target_seq),
    )
