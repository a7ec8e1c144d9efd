"""Deleting in bulk, always previewed by a report over the same selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.operators.listing import SAMPLE_ROWS, newest_first, pick
from hrefmill.plans.skew import anti_by_key

Domains = Iterable[str] | DataFrame | None

# Fixed values.
LINK_KINDS = ["duplicate", "internal", "by-domain", "all"]


def selection(kind: str, domains: Iterable[str] | None = None) -> Column:
    """Condition of the links a prune kind removes; by-domain without domains removes none."""
    if kind == "duplicate":
        return F.col("duplicate_of").isNotNull()
    if kind == "internal":
        return F.coalesce("is_internal", F.lit(False))
    if kind == "by-domain":
        names = list(domains or [])
        return F.coalesce(F.col("domain").isin(names), F.lit(False)) if names else F.lit(False)
    if kind == "all":
        return F.lit(True)
    raise ValueError(f"unknown prune kind: {kind}")


def doomed_links(links: DataFrame, kind: str, domains: Domains = None) -> DataFrame:
    """The links a prune kind removes; the domains may be a list of any length or a DataFrame."""
    if kind == "by-domain" and domains is not None:
        return pick(links, "domain", domains)
    return links.filter(selection(kind))


def cascade_count(results: DataFrame, doomed: DataFrame) -> DataFrame:
    """Number of results that go with the given links; results are counted per link first."""
    per_link = results.groupBy(F.col("link_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return per_link.join(doomed.select("id"), "id", "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("test_results")
    )


def prune_report(links: DataFrame, results: DataFrame, kind: str, domains: Domains = None) -> DataFrame:
    """Dry run, one row: links and results that would be removed."""
    doomed = doomed_links(links, kind, domains)
    counted = doomed.agg(F.count(F.lit(1)).alias("links")).withColumn("__one", F.lit(1))
    cascade = cascade_count(results, doomed).withColumn("__one", F.lit(1))
    return counted.join(cascade, "__one").select(F.lit(kind).alias("kind"), "links", "test_results")


def prune_sample(links: DataFrame, kind: str, domains: Domains = None, limit: int = SAMPLE_ROWS) -> DataFrame:
    doomed = newest_first(doomed_links(links, kind, domains)).limit(limit)
    shown = ["id", "original_url", "domain", "status", "created_at"]
    return doomed.select(*shown, *(["duplicate_of"] if kind == "duplicate" else []))


def prune_links(links: DataFrame, kind: str, domains: Domains = None) -> DataFrame:
    """The links left; a link without a domain is in no list of domains."""
    if kind == "by-domain" and domains is not None:
        gone = doomed_links(links, kind, domains).select("domain").distinct()
        return anti_by_key(links, gone, "domain", F.col("id")).select(*links.columns)
    return links.filter(~F.coalesce(selection(kind), F.lit(False)))


def cascade_results(results: DataFrame, doomed: DataFrame) -> DataFrame:
    """Results left when the given links go; a link may own most of the results."""
    return anti_by_key(results, doomed.select("id"), "link_id", F.col("id")).select(*results.columns)


def detach_jobs(operations: DataFrame, removed_jobs: DataFrame) -> DataFrame:
    """Operations outlive their job and only lose the reference; those without one are not shuffled."""
    gone = removed_jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("__gone"))
    kept = (
        operations.filter(F.col("job_id").isNotNull())
        .join(gone, "job_id", "left")
        .withColumn("job_id", F.when(F.col("__gone").isNull(), F.col("job_id")))
        .select(*operations.columns)
    )
    return kept.unionByName(operations.filter(F.col("job_id").isNull()))


def emptied(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def prune_database(
    links: DataFrame, jobs: DataFrame, results: DataFrame, operations: DataFrame
) -> dict[str, DataFrame]:
    """Next versions of the four tables: links, jobs and results empty, the log kept and detached."""
    return {
        "links": emptied(links),
        "import_jobs": emptied(jobs),
        "test_results": emptied(results),
        "operations": operations.withColumn("job_id", F.lit(None).cast("string")),
    }


def database_report(links: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias(name)).withColumn("__one", F.lit(1)) for name, df in
              [("links", links), ("jobs", jobs), ("test_results", results)]]
    return counts[0].join(counts[1], "__one").join(counts[2], "__one").drop("__one")


def prune_audit(operations: DataFrame, snapshots: DataFrame) -> dict[str, DataFrame]:
    return {"operations": emptied(operations), "snapshots": emptied(snapshots)}


def audit_report(operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    ops = operations.agg(F.count(F.lit(1)).alias("operations")).withColumn("__one", F.lit(1))
    snaps = snapshots.agg(F.count(F.lit(1)).alias("snapshots")).withColumn("__one", F.lit(1))
    return ops.join(snaps, "__one").drop("__one")


def prune_sources(jobs: DataFrame, deleted_files: DataFrame) -> DataFrame:
    """Jobs left when source files are deleted; the links read from them stay."""
    return jobs.join(deleted_files.select("filename"), "filename", "left_anti").select(*jobs.columns)


def file_sample(files: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    return files.orderBy("filename").limit(limit)
