"""Stored availability results: per link, per job, and folded into link status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.operators.listing import pick
from hrefmill.operators.transitions import bulk_update


def results_of_link(results: DataFrame, link_id: str) -> DataFrame:
    return results.filter(F.col("link_id") == link_id)


def results_of_links(results: DataFrame, ids: DataFrame) -> DataFrame:
    return pick(results, "link_id", ids)


def method_progress(results: DataFrame) -> DataFrame:
    """Totals per probing method."""
    return results.groupBy("method").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def outcome(method: Column, status: Column, error: Column) -> Column:
    """Link status that a result stands for."""
    reason = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status == "success", "success")
        .when(reason.contains("timeout"), "timeout")
        .when(reason.contains("refused"), "connection_refused")
        .when(method == "dns", "dns_failed")
        .otherwise("error")
    )


def latest_outcomes(results: DataFrame) -> DataFrame:
    """``id, status`` from the newest result of each link; combined before the shuffle."""
    newest = F.max_by(F.struct("method", "status", "error"), F.struct("completed_at", "id"))
    return (
        results.groupBy(F.col("link_id"))
        .agg(newest.alias("r"))
        .select(F.col("link_id").alias("id"), outcome(F.col("r.method"), F.col("r.status"), F.col("r.error")).alias("status"))
    )


def fold_results(links: DataFrame, results: DataFrame) -> DataFrame:
    """Next version of the links with the status of their newest result."""
    return bulk_update(links, latest_outcomes(results))
