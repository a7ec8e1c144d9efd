"""Join a one-row-per-key table back to its rows when one key may own a third of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.storage import cut_lineage

MAX_HOT_KEYS = 1000
HOT_ROWS = 100_000
#: A table of at most so many keys is sent to all tasks whole, and no row moves.
BROADCAST_KEYS = 10_000


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    spread: Column,
    size: str = "n",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``per_key`` (unique on ``key``, row count in ``size``) to ``rows``.

    ``per_key`` is computed once and kept, so its size and hot keys are known when the join is planned. A
    small one (``BROADCAST_KEYS``) is broadcast whole. Otherwise, if there are hot keys, the biggest, at most ``MAX_HOT_KEYS``, are broadcast: their rows find their match
    without a shuffle by key, and in the shuffle that serves all other keys they go to a slot drawn
    from ``spread`` instead of all to one task. NULL keys match nothing and are spread the same way.
    """
    values = [c for c in per_key.columns if c != key]
    # The slot must be data: a literal here would let Catalyst turn the join on (key, slot) into a
    # join on the key alone.
    per_key = cut_lineage(per_key.withColumn("__slot", F.lit(0).cast("bigint")))
    if per_key.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(per_key.drop("__slot")), key, "left").select(*rows.columns, *values)
    hot = per_key.filter(F.col(size) >= hot_rows)
    tagged, is_hot = rows, F.lit(False)
    if not hot.isEmpty():
        biggest = hot.orderBy(F.desc(size), F.asc(key)).limit(MAX_HOT_KEYS)
        renamed = biggest.select(key, F.lit(True).alias("__hot"), *[F.col(v).alias(f"__hot_{v}") for v in values])
        tagged = rows.join(F.broadcast(renamed), key, "left")
        is_hot = F.coalesce("__hot", F.lit(False))
    anywhere = F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1
    slot = F.when(is_hot | F.col(key).isNull(), anywhere).otherwise(F.lit(0).cast("bigint"))
    joined = tagged.withColumn("__slot", slot).join(per_key, [key, "__slot"], "left")
    if tagged is rows:
        return joined.select(*rows.columns, *values)
    picked = [F.when(is_hot, F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return joined.select(*rows.columns, *picked)


def _matched(rows: DataFrame, keys: DataFrame, key: str, spread: Column) -> DataFrame:
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).join(
        keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi"
    )
    return attach_by_key(rows, sizes, key, spread, size="__rows")


def semi_by_key(rows: DataFrame, keys: DataFrame, key: str, spread: Column) -> DataFrame:
    """Rows whose key is in the first column of ``keys``; safe for a key owning many rows."""
    return _matched(rows, keys, key, spread).filter(F.col("__rows").isNotNull()).drop("__rows")


def anti_by_key(rows: DataFrame, keys: DataFrame, key: str, spread: Column) -> DataFrame:
    """Rows whose key is not in the first column of ``keys``."""
    return _matched(rows, keys, key, spread).filter(F.col("__rows").isNull()).drop("__rows")
