"""Distributed positions: dense row numbers and running values without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.storage import cut_lineage

ROWS_PER_BUCKET = 65_536


def sorted_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-sort by ``order`` (which must be unique) and add ``__block`` and ``__idx``.

    A block is one range partition. Ranges are cut by sampled quantiles of a unique sort key, so no
    value can make a block heavy. The result is checkpointed: block numbers must not change when
    a lost task is run again.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return cut_lineage(
        ordered.withColumns(
            {"__block": F.spark_partition_id(), "__idx": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
        )
    )


def with_global_position(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Add the dense 0-based position of each row in the total order given by ``order``."""
    blocks = sorted_blocks(df, order)
    sizes = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    # One row per block, thus as many rows as there are partitions.
    offsets = sizes.select(
        "__block",
        (F.sum("__n").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).alias("__before"),
    )
    return (
        blocks.join(offsets, "__block")
        .withColumn(out, F.coalesce("__before", F.lit(0)) + F.col("__idx"))
        .drop("__block", "__idx", "__before")
    )


def with_rank_in_group(
    df: DataFrame, group: str, position: str, out: str, counted: Column | None = None, width: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add the 0-based rank of each counted row by ``position`` inside ``group``.

    ``position`` is a non-negative integer unique within the group. Rows are ranked inside buckets
    of ``width`` positions and a small table of bucket sizes supplies the offset, so a group of any
    size is ranked by many tasks. Rows that are not counted get NULL.
    """
    hit = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    base = df.withColumns({"__bucket": F.floor(F.col(position) / width), "__hit": hit})
    sizes = base.groupBy(group, "__bucket").agg(F.count_if("__hit").alias("__n"))
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.sum(F.col("__hit").cast("int")).over(
        W.partitionBy(group, "__bucket").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    )
    ranked = base.withColumn("__local", local).join(offsets, [group, "__bucket"])
    return ranked.withColumn(out, F.when(F.col("__hit"), F.col("__before") + F.col("__local") - 1)).drop(
        "__bucket", "__hit", "__local", "__before"
    )


def last_value_before(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Carry the latest non-NULL ``value`` forward over a total order (an as-of join's second half)."""
    blocks = sorted_blocks(df, order)
    inside = W.partitionBy("__block").orderBy("__idx").rowsBetween(W.unboundedPreceding, 0)
    tails = blocks.groupBy("__block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__idx"))).alias("__tail")
    )
    carried = tails.select(
        "__block",
        F.last("__tail", ignorenulls=True)
        .over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
        .alias("__carry"),
    )
    return (
        blocks.withColumn("__in", F.last(value, ignorenulls=True).over(inside))
        .join(carried, "__block")
        .withColumn(out, F.coalesce("__in", "__carry"))
        .drop("__block", "__idx", "__in", "__carry")
    )


def with_running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row in a total order."""
    blocks = sorted_blocks(df, order)
    inside = W.partitionBy("__block").orderBy("__idx").rowsBetween(W.unboundedPreceding, -1)
    sums = blocks.groupBy("__block").agg(F.sum(value).alias("__sum"))
    carried = sums.select(
        "__block", F.sum("__sum").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)).alias("__carry")
    )
    zero = F.lit(0).cast("bigint")
    return (
        blocks.withColumn("__in", F.sum(value).over(inside))
        .join(carried, "__block")
        .withColumn(out, F.coalesce("__in", zero) + F.coalesce("__carry", zero))
        .drop("__block", "__idx", "__in", "__carry")
    )
