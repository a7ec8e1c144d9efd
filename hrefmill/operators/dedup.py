"""Exact duplicates: group active links by a normalised URL and keep the first.

A strategy is the name of a preset or a ``NormalizeConfig`` of one's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.functions.urls import NormalizeConfig, dedup_preset, with_dedup_key
from hrefmill.operators.listing import is_active
from hrefmill.plans.skew import attach_by_key


def keep_order(sort: str) -> Column:
    """What decides which row of a group is kept; ``seq`` breaks every tie."""
    if sort == "original":
        return F.struct("seq")
    if sort in ("alphabetical", "domain"):
        text = "original_url" if sort == "alphabetical" else "domain"
        return F.struct(F.collate(F.col(text), "UNICODE"), F.col("seq"))
    raise ValueError(f"unknown sort: {sort}")


def _keepers(active: DataFrame, sort: str) -> DataFrame:
    """One row per ``dedup_key`` that occurs more than once, with the row that is kept."""
    keeper = F.min_by(F.struct("id", "original_url", "seq"), keep_order(sort))
    return (
        active.groupBy("dedup_key")
        .agg(F.count(F.lit(1)).alias("n"), keeper.alias("keep"))
        .filter("n > 1")
        .select(
            "dedup_key",
            "n",
            F.col("keep.id").alias("keep_id"),
            F.col("keep.original_url").alias("keep_url"),
            F.col("keep.seq").alias("keep_seq"),
        )
    )


def _active(links: DataFrame) -> DataFrame:
    # Filter on the stored status, never on the computed key: Catalyst would push such a filter
    # below the projections that build the key and compute it twice.
    return links.filter(is_active(F.col("status")))


def duplicate_groups(links: DataFrame, strategy: str | NormalizeConfig = "normalized", sort: str = "original") -> DataFrame:
    """One row per duplicate, next to the row that is kept.

    Groups stay in long form because a group may be as large as the table. ``keep_seq`` orders the
    groups by first appearance and ``duplicate_seq`` the members.
    """
    keyed = with_dedup_key(_active(links), dedup_preset(strategy))
    rows = keyed.select("dedup_key", "id", "original_url", "seq")
    members = attach_by_key(rows, _keepers(keyed, sort), "dedup_key", F.col("seq"))
    return members.filter("n > 1 AND id != keep_id").select(
        F.col("dedup_key").alias("normalized_url"),
        "keep_id",
        "keep_url",
        "keep_seq",
        F.col("n").alias("group_size"),
        F.col("id").alias("duplicate_id"),
        F.col("original_url").alias("duplicate_url"),
        F.col("seq").alias("duplicate_seq"),
    )


def dedup_preview(links: DataFrame, strategy: str | NormalizeConfig = "normalized") -> DataFrame:
    """One row of counts, from the grouped keys alone."""
    keyed = with_dedup_key(_active(links), dedup_preset(strategy))
    sizes = keyed.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count_if(F.col("n") > 1).alias("group_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.count(F.lit(1)).alias("remaining_count"),
    )


def dedup_execute(links: DataFrame, strategy: str | NormalizeConfig = "normalized", sort: str = "original") -> DataFrame:
    """All links; the ones not kept become ``duplicate_removed`` and point to the kept row."""
    preset = dedup_preset(strategy)
    keepers = _keepers(with_dedup_key(_active(links), preset), sort).select("dedup_key", "n", "keep_id")
    keyed = with_dedup_key(links, preset).withColumn(
        "dedup_key", F.when(is_active(F.col("status")), F.col("dedup_key"))
    )
    marked = attach_by_key(keyed, keepers, "dedup_key", F.col("seq"))
    drop = F.coalesce((F.col("n") > 1) & (F.col("id") != F.col("keep_id")), F.lit(False))
    return marked.withColumns(
        {
            "status": F.when(drop, "duplicate_removed").otherwise(F.col("status")),
            "duplicate_of": F.when(drop, F.col("keep_id")).otherwise(F.col("duplicate_of")),
            "updated_at": F.when(drop, F.current_timestamp()).otherwise(F.col("updated_at")),
        }
    ).select(*links.columns)
