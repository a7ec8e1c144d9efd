"""From extracted links to link rows, and the bookkeeping of import jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill import schemas
from hrefmill.functions.text import is_blank
from hrefmill.functions.urls import PARTS, PRESETS, import_preset, normalized, with_url_parts
from hrefmill.plans.ordering import with_global_position, with_rank_in_group, with_running_total
from hrefmill.plans.skew import anti_by_key, attach_by_key, semi_by_key
from hrefmill.sources.formats import EXTRACTORS, Extractor, extract_links, read_formats
from hrefmill.storage import cut_lineage

FILENAME_SHOWN = 100


def with_validity(links: DataFrame, url: str = "url") -> DataFrame:
    """Parse ``url`` into ``u_*`` parts and add ``is_valid``; blank text is not reported as invalid."""
    parsed = with_url_parts(links, url)
    return parsed.withColumn("is_valid", F.col("u_scheme").isNotNull() | is_blank(F.col(url)))


def partition_valid(links: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """``(valid links, invalid links)``; both keep their ordering columns."""
    checked = with_validity(links, url).drop(*[f"u_{k}" for k in PARTS])
    return checked.filter("is_valid").drop("is_valid"), checked.filter("NOT is_valid").drop("is_valid")


def _without_marker(part: Column) -> Column:
    """Stored query and hash drop their ``?`` / ``#``; empty becomes NULL."""
    return F.nullif(F.substring(part, F.lit(2), F.length(part)), F.lit(""))


def build_link_rows(parsed: DataFrame, created_at: Column) -> DataFrame:
    """Full link rows from ``seq source_file source_order type strategy url title`` and ``u_*`` parts.

    Parts come from the original URL, so that searching for a fragment or a www host still works
    when the normalised form drops it. The id is a hash of ``seq``, so a retried task repeats it.
    """
    url = F.col("url")
    known = F.col("strategy").isin(list(schemas.STRATEGIES))
    norm = F.when(known, url).otherwise(
        F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce("strategy", F.lit("NULL"))))
    )
    for strategy in schemas.STRATEGIES:
        config = PRESETS[import_preset(strategy)]
        if config is not None:
            norm = F.when(F.col("strategy") == strategy, normalized("u_", config, url)).otherwise(norm)
    now = created_at.cast("timestamp")
    none = F.lit(None).cast("string")
    values = {
        "seq": F.col("seq"),
        "id": F.md5(F.col("seq").cast("string")),
        "original_url": url,
        "normalized_url": norm,
        "domain": F.coalesce("u_host", F.lit("")),
        "url_path": F.nullif(F.col("u_path"), F.lit("")),
        "url_query": _without_marker(F.col("u_search")),
        "url_hash": _without_marker(F.col("u_hash")),
        "title": F.coalesce("title", F.lit("")),
        "source": F.col("type"),
        "source_file": F.col("source_file"),
        "source_order": F.col("source_order").cast("bigint"),
        "status": F.lit("imported"),
        "tags": F.array().cast("array<string>"),
        "is_internal": F.lit(False),
        "similarity_group": none,
        "duplicate_of": none,
        "created_at": now,
        "updated_at": now,
    }
    return parsed.select(*[values[c].alias(c) for c in schemas.LINKS.fieldNames()])


def parse_sources(
    lines: DataFrame, jobs: DataFrame, extractors: list[Extractor] = EXTRACTORS
) -> DataFrame:
    """Extract, validate and number the links of all files that have a job.

    ``jobs`` gives ``job_seq filename type strategy``. Rows carry ``is_valid``; ``source_order``
    counts valid links only and is NULL for the others. Feed the result to ``new_links`` and
    ``job_counts``. Each URL is parsed once: the checked links are kept before they are numbered.
    """
    profile, scan = read_formats(lines, jobs.select("filename", "type"), extractors)
    found = extract_links(lines, profile, extractors, scan)
    checked = cut_lineage(with_validity(found))
    ranked = with_rank_in_group(checked, "filename", "pos", "source_order", F.col("is_valid"))
    per_job = checked.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("valid"))
    facts = jobs.select("filename", "job_seq", "strategy").join(per_job, "filename")
    placed = with_running_total(facts, ["job_seq", "filename"], "valid", "start_seq")
    return attach_by_key(ranked, placed, "filename", F.col("pos")).drop("n", "valid")


def new_links(parsed: DataFrame, created_at: Column | None = None, *, first_seq: int) -> DataFrame:
    """Link rows of the valid links; ``seq`` orders by job, then by place in the file.

    ``first_seq`` is the first number not used by earlier runs (see ``next_seq``); ids follow ``seq``,
    so it has no default: a second import must not repeat the ids of the first.
    """
    valid = parsed.filter("is_valid").withColumns(
        {"source_file": F.col("filename"), "seq": F.col("start_seq") + F.col("source_order") + first_seq}
    )
    return build_link_rows(valid, F.current_timestamp() if created_at is None else created_at)


def next_seq(links: DataFrame) -> int:
    return links.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]


def job_counts(parsed: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Imported and error counts per file, from the data and not by adding to stored counters.

    ``read`` lists the files that were parsed, by ``filename``: those without links count zero.
    """
    counts = parsed.groupBy("filename").agg(
        F.count_if("is_valid").alias("imported_count"), F.count_if(~F.col("is_valid")).alias("error_count")
    )
    if read is None:
        return counts
    zero = F.lit(0).cast("bigint")
    return read.select("filename").distinct().join(counts, "filename", "left").select(
        "filename", F.coalesce("imported_count", zero).alias("imported_count"), F.coalesce("error_count", zero).alias("error_count")
    )


def stored_counts(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` of files parsed again, with all stored rows of the file as imported."""
    stored = links.groupBy(F.col("source_file").alias("filename")).agg(F.count(F.lit(1)).alias("__stored"))
    return counts.join(stored, "filename", "left").select(
        "filename", F.coalesce("__stored", F.lit(0).cast("bigint")).alias("imported_count"), "error_count"
    )


def finish_jobs(jobs: DataFrame, counts: DataFrame, files: DataFrame, completed_at: Column) -> DataFrame:
    """Jobs whose file was parsed become completed with their counts and the file's time."""
    done = counts.select("filename", F.col("imported_count").alias("__ok"), F.col("error_count").alias("__bad"))
    seen = files.select("filename", F.col("modified_at").alias("__mtime"))
    hit = F.col("__ok").isNotNull()
    return (
        jobs.join(done, "filename", "left")
        .join(seen, "filename", "left")
        .withColumns(
            {
                "is_reparse": F.when(hit, F.col("status") == "completed").otherwise(F.col("is_reparse")),
                "status": F.when(hit, "completed").otherwise(F.col("status")),
                "imported_count": F.coalesce("__ok", "imported_count"),
                "error_count": F.coalesce("__bad", "error_count"),
                "file_mtime": F.when(hit, F.col("__mtime")).otherwise(F.col("file_mtime")),
                "completed_at": F.when(hit, completed_at).otherwise(F.col("completed_at")),
            }
        )
        .select(*jobs.columns)
    )


def only_new(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidate links whose normalised URL is not stored for the same source file.

    Repeats inside the new file are kept: only stored rows filter.
    """
    key = F.concat_ws("\u0001", "source_file", "normalized_url")
    keyed = candidates.withColumn("__key", key)
    return anti_by_key(keyed, stored.select(key), "__key", F.col("seq")).drop("__key")


def renumbered(links: DataFrame) -> DataFrame:
    """Number ``source_order`` from 0 again in each file, after some links were filtered out."""
    kept = cut_lineage(links)
    ranked = with_rank_in_group(kept, "source_file", "source_order", "__order")
    return ranked.withColumn("source_order", F.col("__order")).select(*links.columns)


def reparse_changed(
    parsed: DataFrame, stored: DataFrame, stale: DataFrame, created_at: Column | None = None, *, first_seq: int
) -> DataFrame:
    """Rows to append when changed files are parsed again; links gone from a file stay stored.

    Pass ``next_seq`` of the stored links as ``first_seq``.
    """
    changed = semi_by_key(parsed, stale.select("filename"), "filename", F.col("pos"))
    return renumbered(only_new(cut_lineage(new_links(changed, created_at, first_seq=first_seq)), stored))


def register_sources(files: DataFrame, jobs: DataFrame, first_seq: int = 0, strategy: str = "normalized") -> DataFrame:
    """Pending jobs for files that have none; ``files`` gives ``filename type``. Safe to repeat.

    Jobs are numbered in the order of their file names.
    """
    missing = files.join(jobs.select("filename"), "filename", "left_anti").select("filename", "type")
    return with_global_position(missing, ["filename"]).select(
        (F.col("pos") + first_seq).alias("job_seq"),
        F.md5("filename").alias("id"),
        "type",
        "filename",
        F.lit(strategy).alias("strategy"),
        F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("imported_count"),
        F.lit(0).cast("bigint").alias("error_count"),
        F.lit(None).cast("timestamp").alias("file_mtime"),
        F.lit(False).alias("is_reparse"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def stale_sources(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Completed jobs whose file time differs from the stored one; a missing time counts as stale."""
    done = jobs.filter("status = 'completed'")
    return done.join(files.select("filename", "modified_at"), "filename").filter(
        ~F.col("modified_at").eqNullSafe(F.col("file_mtime"))
    )


def files_with_jobs(files: DataFrame, jobs: DataFrame) -> DataFrame:
    return files.join(jobs, "filename", "left")


def shown_filename(c: Column) -> Column:
    return F.when(F.length(c) > FILENAME_SHOWN, F.concat(F.left(c, F.lit(FILENAME_SHOWN)), F.lit("…"))).otherwise(c)


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_seq")).select(
        F.col("id").alias("job_id"),
        shown_filename(F.col("filename")).alias("filename"),
        "type",
        "strategy",
        "status",
        "imported_count",
        "error_count",
        "file_mtime",
        "created_at",
    )


def get_job(jobs: DataFrame, filename: str) -> DataFrame:
    return list_jobs(jobs.filter(F.col("filename") == filename))


def first_per_url(links: DataFrame) -> DataFrame:
    """Keep the first of each raw URL over all files, in file name and then line order."""
    order = F.struct("filename", "pos")
    return links.groupBy("url").agg(F.min_by(F.struct("filename", "pos", "title"), order).alias("f")).select(
        "f.filename", "f.pos", "url", "f.title"
    )


def extract_directory(lines: DataFrame, types: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(per-file format, line and link counts, links that are the first of their URL)``."""
    visible = lines.filter(~F.col("filename").rlike(r"(^|/)\."))
    profile, scan = read_formats(visible, types)
    links = cut_lineage(extract_links(visible, profile, scan=scan))
    counts = links.groupBy("filename").agg(F.count(F.lit(1)).alias("links"))
    per_file = profile.join(counts, "filename", "left").select(
        "filename", "format", F.col("n").alias("lines"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links")
    )
    return per_file, first_per_url(links)


def backfill_url_parts(links: DataFrame) -> DataFrame:
    """Recompute path, query and hash; ``changed`` marks rows whose stored parts differ."""
    parsed = with_url_parts(links, "original_url")
    fresh = {
        "url_path": F.nullif(F.col("u_path"), F.lit("")),
        "url_query": _without_marker(F.col("u_search")),
        "url_hash": _without_marker(F.col("u_hash")),
    }
    changed = F.lit(False)
    for name, value in fresh.items():
        changed = changed | ~F.col(name).eqNullSafe(value)
    return parsed.withColumn("changed", changed).withColumns(fresh).select(*links.columns, "changed")


def backfill_dry_run(links: DataFrame) -> DataFrame:
    """One row: rows scanned, rows that would get parts, rows that would lose all parts."""
    empty = F.col("url_path").isNull() & F.col("url_query").isNull() & F.col("url_hash").isNull()
    return backfill_url_parts(links).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("changed") & ~empty).alias("would_update"),
        F.count_if(F.col("changed") & empty).alias("would_null"),
    )
