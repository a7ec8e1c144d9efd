"""Exports of links and of source files in a standard form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.operators.listing import links_by_ids, links_by_status
from hrefmill.plans.skew import attach_by_key
from hrefmill.sources.files import content_hashes
from hrefmill.sources.formats import detect_formats, extract_links, read_formats
from hrefmill.storage import cut_lineage

# Exported columns and their headings.
CSV_COLUMNS = {
    "id": "id",
    "originalUrl": "original_url",
    "normalizedUrl": "normalized_url",
    "domain": "domain",
    "title": "title",
    "source": "source",
    "status": "status",
    "tags": "tags",
    "isInternal": "is_internal",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
}
CSV_HEADER = ",".join(CSV_COLUMNS)
PREVIEW_ROWS = 10


def select_for_export(links: DataFrame, ids: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """By ids, else by status, else everything."""
    if ids is not None:
        return links_by_ids(links, ids)
    return links if status is None else links_by_status(links, status)


def _cell(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind.startswith("array"):
        text = F.to_json(name)
    elif kind == "timestamp":
        text = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    else:
        text = F.col(name).cast("string")
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(links: DataFrame) -> DataFrame:
    """One quoted CSV line per link, without the heading."""
    return links.select("seq", F.concat_ws(",", *[_cell(links, c) for c in CSV_COLUMNS.values()]).alias("line"))


def write_links_csv(links: DataFrame, path: str) -> None:
    """CSV part files, each with the heading, every value quoted and quotes doubled."""
    flat = links.select(
        *[
            (F.to_json(c) if dict(links.dtypes)[c].startswith("array") else F.col(c).cast("string")).alias(name)
            for name, c in CSV_COLUMNS.items()
        ]
    )
    flat.na.fill("").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def json_lines(links: DataFrame) -> DataFrame:
    """One JSON object per link, NULL fields kept."""
    return links.select("seq", F.to_json(F.struct(*links.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_links_json(links: DataFrame, path: str) -> None:
    links.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def content_hash8(content: Column) -> Column:
    """Short hash of a content in one row; ``content_hashes`` gives that of files of any size."""
    return F.left(F.sha2(content, 256), F.lit(8))


def safe_stem(filename: Column) -> Column:
    """Base name without its last extension."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.when(base.contains("."), F.regexp_extract(base, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(base)
    return F.regexp_replace(stem, r"[/\\]", "-")


def export_name(filename: Column, hash8: Column) -> Column:
    return F.concat(safe_stem(filename), F.lit("-"), hash8, F.lit(".json"))


def classify_sources(lines: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Format or error per file; nothing is extracted."""
    found = detect_formats(lines, types)
    return found.select("filename", F.when(F.col("error").isNull(), F.col("format")).alias("format"), "error")


def needs_conversion(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("format") != "json_array")


def preview_sources(lines: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Per file: format, link count, first raw lines and first links."""
    profile, scan = read_formats(lines, types)
    links = cut_lineage(extract_links(lines, profile, scan=scan))
    counts = links.groupBy("filename").agg(F.count(F.lit(1)).alias("link_count"))
    nth = F.row_number().over(W.partitionBy("filename").orderBy("pos"))
    first = (
        links.withColumn("__nth", nth)
        .filter(F.col("__nth") <= PREVIEW_ROWS)
        .groupBy("filename")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "url", "title"))).alias("sample"))
    )
    return (
        profile.join(counts, "filename", "left")
        .join(first, "filename", "left")
        .select(
            "filename",
            "format",
            F.coalesce("link_count", F.lit(0).cast("bigint")).alias("link_count"),
            F.col("sniff").alias("raw_sample"),
            F.transform(F.coalesce("sample", F.array().cast("array<struct<pos:bigint,url:string,title:string>>")),
                        lambda s: F.struct(s["url"].alias("url"), s["title"].alias("title"))).alias("sample"),
            "error",
        )
    )


def export_names(lines: DataFrame) -> DataFrame:
    """``filename, export_name`` of every file; the name carries the hash of its content."""
    short = F.left("sha256", F.lit(8))
    return content_hashes(lines).select("filename", export_name(F.col("filename"), short).alias("export_name"))


def export_sources(lines: DataFrame, types: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``export_name, pos, url, title`` of all files, less those whose export name already exists.

    Write it with ``write_exports``; the rows of one file may be spread over many tasks.
    """
    profile, scan = read_formats(lines, types)
    names = export_names(lines)
    if existing is not None:
        names = names.join(existing.select("export_name"), "export_name", "left_anti")
    links = cut_lineage(extract_links(lines, profile, scan=scan))
    sized = names.join(links.groupBy("filename").agg(F.count(F.lit(1)).alias("n")), "filename")
    return attach_by_key(links.select("filename", "pos", "url", "title"), sized, "filename", F.col("pos")).filter(
        F.col("export_name").isNotNull()
    ).select("filename", "export_name", "pos", "url", "title")


def write_exports(exports: DataFrame, path: str, rows_per_part: int = 1_000_000) -> None:
    """JSON lines below one folder per export name; long exports become several ordered parts."""
    part = F.floor(F.col("pos") / rows_per_part).alias("part")
    (
        exports.select("export_name", part, "pos", "url", "title")
        .repartition("export_name", "part")
        .sortWithinPartitions("export_name", "part", "pos")
        .select("export_name", "part", "url", "title")
        .write.mode("append")
        .partitionBy("export_name", "part")
        .json(path)
    )
