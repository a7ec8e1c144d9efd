"""State changes of the link table: each maps links to the next version of all links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill import schemas
from hrefmill.functions.urls import is_private_host
from hrefmill.operators.listing import is_active, scan_active_links
from hrefmill.operators.similarity import DEFAULT_LAYERS, Layer, detect_similarity
from hrefmill.plans.skew import semi_by_key

EDITABLE = ["title", "tags", "status"]


def change(links: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the rows where a condition holds; ``updated_at`` follows."""
    hit = F.coalesce(where, F.lit(False))
    stamped = {**values, "updated_at": F.current_timestamp()}
    return links.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in stamped.items()})


def append_links(links: DataFrame, fresh: DataFrame) -> DataFrame:
    return links.unionByName(fresh.select(*links.columns))


def bulk_update(links: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``updates`` (unique ``id`` plus columns to set, NULL meaning keep) to the links."""
    names = [c for c in updates.columns if c != "id"]
    renamed = updates.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = links.join(renamed, "id", "left")
    values = {c: F.coalesce(f"__{c}", c) for c in names}
    return change(joined, F.col("__hit"), values).select(*links.columns)


def manual_update(links: DataFrame, ids: DataFrame, **values: Column) -> DataFrame:
    """Set title, tags or status on selected links."""
    unknown = set(values) - set(EDITABLE)
    if unknown:
        raise ValueError(f"not editable: {sorted(unknown)}")
    marked = links.join(ids.select("id", F.lit(True).alias("__hit")).dropDuplicates(["id"]), "id", "left")
    return change(marked, F.col("__hit"), values).select(*links.columns)


def set_status(links: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    if status not in schemas.LINK_STATUSES:
        raise ValueError(f"unknown status: {status}")
    return manual_update(links, ids, status=F.lit(status))


def add_tag(links: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """Append a trimmed tag to selected links that lack it; a blank tag changes nothing."""
    text = tag.strip()
    if not text:
        return links
    marked = links.join(ids.select("id", F.lit(True).alias("__hit")).dropDuplicates(["id"]), "id", "left")
    missing = F.col("__hit") & ~F.array_contains("tags", text)
    return change(marked, missing, {"tags": F.array_append("tags", F.lit(text))}).select(*links.columns)


def delete_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select("id"), "id", "left_anti")


def filter_internal_execute(links: DataFrame, ids: DataFrame | None = None, strict_cidr: bool = False) -> DataFrame:
    """Mark links on private hosts, among the given ids or else all active links."""
    private = is_private_host(F.col("domain"), strict_cidr)
    values = {"status": F.lit("filtered_internal"), "is_internal": F.lit(True)}
    if ids is None:
        return change(links, is_active(F.col("status")) & private, values)
    marked = links.join(ids.select("id", F.lit(True).alias("__hit")).dropDuplicates(["id"]), "id", "left")
    return change(marked, F.col("__hit") & private, values).select(*links.columns)


def filter_similar_execute(
    links: DataFrame,
    layers: list[Layer] = DEFAULT_LAYERS,
    selected: DataFrame | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Keep the first link of each group and mark the others.

    ``selected`` limits the groups by ``group_key``: none given means all, an empty one means none.
    With ``ids`` the groups are built over those links, newest first.
    """
    if ids is None:
        targets = scan_active_links(links)
    else:
        chosen = links.join(ids.select("id"), "id", "left_semi")
        # The newest of the chosen links comes first, so the order key is turned around.
        targets = chosen.select("id", (-F.col("seq")).alias("seq"), "original_url", "normalized_url", "domain")
    members = detect_similarity(targets, layers)
    if selected is not None:
        members = semi_by_key(members, selected.select("group_key"), "group_key", F.col("seq"))
    marks = members.select("id", F.col("group_key").alias("__group"), F.col("keep_id").alias("__keep"))
    joined = links.join(marks, "id", "left")
    grouped = change(joined, F.col("__group").isNotNull(), {"similarity_group": F.col("__group")})
    return change(
        grouped,
        F.col("__keep") != F.col("id"),
        {"status": F.lit("filtered_similar"), "duplicate_of": F.col("__keep")},
    ).select(*links.columns)
