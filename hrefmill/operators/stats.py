"""Counts over links and the other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hrefmill.functions.urls import is_private_host
from hrefmill.operators.listing import is_active

# Statuses the dashboard always shows.
HIGHLIGHTED = ["imported", "success", "pending"]


def count_rows(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def status_counts(links: DataFrame) -> DataFrame:
    """Links per status; the row with a NULL status is the total, from the same pass."""
    return links.rollup("status").agg(F.count(F.lit(1)).alias("links"))


def status_breakdown(links: DataFrame) -> DataFrame:
    """Statuses by size, the highlighted ones present even at zero."""
    shown = links.sparkSession.createDataFrame([(s, True) for s in HIGHLIGHTED], "status string, highlighted boolean")
    counts = links.groupBy("status").agg(F.count(F.lit(1)).alias("links"))
    return (
        counts.join(shown, "status", "full_outer")
        .select(
            "status",
            F.coalesce("links", F.lit(0).cast("bigint")).alias("links"),
            F.coalesce("highlighted", F.lit(False)).alias("highlighted"),
        )
        .orderBy(F.desc("links"), "status")
    )


def domain_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("domain").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "domain")


def resolved_url_count(links: DataFrame) -> DataFrame:
    return links.filter(is_active(F.col("status"))).agg(F.count_distinct("original_url").alias("resolved"))


def links_per_source_file(links: DataFrame) -> DataFrame:
    return links.groupBy("source_file").agg(F.count(F.lit(1)).alias("links"))


def _chosen(links: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Active links, or whichever links are named."""
    if ids is None:
        return links.filter(is_active(F.col("status")))
    return links.join(ids.select("id").distinct(), "id", "left_semi")


def internal_preview(links: DataFrame, strict_cidr: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """One row: links on private hosts and the rest, of the given ids or else of all active links."""
    private = is_private_host(F.col("domain"), strict_cidr)
    return _chosen(links, ids).agg(
        F.count_if(private).alias("filtered_count"), F.count_if(~private).alias("remaining_count")
    )


def internal_ids(links: DataFrame, strict_cidr: bool = False, ids: DataFrame | None = None) -> DataFrame:
    return _chosen(links, ids).filter(is_private_host(F.col("domain"), strict_cidr)).select("id")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, total)`` of several tables, one row each."""
    out = None
    for name, df in tables.items():
        row = count_rows(df).select(F.lit(name).alias("name"), "total")
        out = row if out is None else out.unionByName(row)
    return out


SKETCH_BITS = 14


def url_sketches(links: DataFrame, by: str = "source_file", bits: int = SKETCH_BITS) -> DataFrame:
    """``(by, links, sketch)``: a mergeable sketch of the distinct active URLs of each group, some 2 ** ``bits`` bytes.

    Keep it as a table: any choice of groups is then counted without reading links again. A NULL group is one.
    """
    active = links.filter(is_active(F.col("status")))
    return active.groupBy(by).agg(F.count(F.lit(1)).alias("links"), F.hll_sketch_agg("original_url", bits).alias("sketch"))


def sketched_url_count(sketches: DataFrame) -> DataFrame:
    """One row: links, and about how many distinct URLs, of all groups of ``sketches``.

    The standard error is 1.04 / sqrt(2 ** bits), 0.8 % at 14 bits. For an exact count see ``resolved_url_count``.
    """
    merged = sketches.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("links", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("resolved"))


def file_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"))


def operation_stats(before: DataFrame, after: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Input, output, duplicate and error counts of a transition, one row; ``errors`` has a row for each error."""
    removed = after.agg(
        F.count(F.lit(1)).alias("stats_output_count"),
        F.count_if(F.col("status") == "duplicate_removed").alias("__dup"),
    )
    given = before.agg(
        F.count(F.lit(1)).alias("stats_input_count"),
        F.count_if(F.col("status") == "duplicate_removed").alias("__dup0"),
    )
    failed = before.limit(0) if errors is None else errors
    return (
        given.withColumn("__one", F.lit(1))
        .join(removed.withColumn("__one", F.lit(1)), "__one")
        .join(count_rows(failed, "stats_error_count").withColumn("__one", F.lit(1)), "__one")
        .select(
            "stats_input_count",
            "stats_output_count",
            (F.col("__dup") - F.col("__dup0")).alias("stats_duplicate_count"),
            "stats_error_count",
        )
    )


def write_observed(before: DataFrame, after: DataFrame, write: Callable[[DataFrame], None], errors: DataFrame | None = None) -> DataFrame:
    """Let ``write`` store the state after a transition, and give what ``operation_stats`` gives.

    The rows written are counted as they pass; the state before is a stored table, whose counts need few columns.
    """
    removed = lambda: F.count_if(F.col("status") == "duplicate_removed")
    seen = Observation()
    write(after.observe(seen, F.count(F.lit(1)).alias("n"), removed().alias("dup")))
    given = before.agg(F.count(F.lit(1)).alias("n"), removed().alias("dup")).first()
    failed = 0 if errors is None else errors.count()
    row = (given["n"], seen.get["n"], seen.get["dup"] - given["dup"], failed)
    names = ("stats_input_count", "stats_output_count", "stats_duplicate_count", "stats_error_count")
    return before.sparkSession.createDataFrame([row], ", ".join(f"{n} long" for n in names))
