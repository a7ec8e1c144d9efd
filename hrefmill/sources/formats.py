"""Format detection and link extraction for the eight export formats.

An extractor is a detection predicate over a file's profile and a way to read: either a column expression from
a line to ``struct<url, title>``, or a function from the lines of its files (and the scan of their JSON) to rows of
``filename, pos, url, title``. Pass a longer list to plug in more formats; list order is the detection priority.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.functions.text import JS_SPACE, csv_fields, decode_entities, is_blank, js_trim
from hrefmill.plans.skew import attach_by_key, semi_by_key
from hrefmill.sources.records import BLOCK, JsonScan, scan_anchors, scan_json
from hrefmill.storage import cut_lineage

SNIFF_LINES = 10
SNIFF_HEAD = 64
BROADCAST_FILES = 50_000


@dataclass(frozen=True)
class Extractor:
    format: str
    type: str
    detect: Column | Callable[[], Column]
    parse_line: Callable[[Column], Column] | None = None
    read: Callable[[DataFrame, JsonScan | None], DataFrame] | None = None


def has_web_scheme(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def _link(url: Column, title: Column) -> Column:
    return F.when(has_web_scheme(url), F.struct(url.alias("url"), title.alias("title")))


def _after(text: Column, head: Column, gap: int) -> Column:
    return F.substring(text, F.length(head) + gap + 1, F.length(text))


def pipe_line(line: Column) -> Column:
    t = js_trim(line)
    left = F.substring_index(t, " | ", 1)
    return F.when(t.contains(" | "), _link(js_trim(left), js_trim(_after(t, left, 3))))


def dash_line(line: Column) -> Column:
    t = js_trim(line)
    right = F.substring_index(t, " - ", -1)
    left = F.substring(t, F.lit(1), F.length(t) - F.length(right) - 3)
    return F.when(t.contains(" - "), _link(js_trim(right), js_trim(left))).otherwise(_link(t, F.lit("")))


def url_line(line: Column) -> Column:
    return _link(js_trim(line), F.lit(""))


def onetab_line(line: Column) -> Column:
    t = js_trim(line)
    left = F.substring_index(t, " * ", 1)
    return (
        F.when(t.startswith("[") & t.endswith("]"), F.lit(None))
        .when(t.contains(" * "), _link(js_trim(left), js_trim(_after(t, left, 3))))
        .when(t.endswith(" *"), _link(js_trim(F.substring(t, F.lit(1), F.length(t) - 2)), F.lit("")))
    )


def csv_line(line: Column) -> Column:
    """Uses ``url_at`` and ``title_at``, the 1-based header positions carried by each line."""
    fields = csv_fields(js_trim(line))
    at = lambda name: js_trim(F.coalesce(F.get(fields, F.col(name).cast("int") - 1), F.lit("")))
    title = F.when(F.col("title_at") > 0, at("title_at")).otherwise("")
    return F.when((F.col("pos") > 0) & (F.col("url_at") > 0), _link(at("url_at"), title))


def json_array_items(lines: DataFrame, scan: JsonScan) -> DataFrame:
    return scan.array_items()


def tablerone_tabs(lines: DataFrame, scan: JsonScan) -> DataFrame:
    return scan.tabs()


def bookmarks(lines: DataFrame, scan: JsonScan | None, size: int = BLOCK) -> DataFrame:
    return scan_anchors(lines, size).withColumn("title", decode_entities(F.col("title")))


def in_blocks_of(size: int) -> list[Extractor]:
    """The extractors, with documents read in blocks of another size."""
    return [replace(e, read=partial(bookmarks, size=size)) if e.read is bookmarks else e for e in EXTRACTORS]


def _any_line(test: Callable[[Column], Column]) -> Column:
    return F.exists("sniff", test)


def _bracketed(line: Column) -> Column:
    t = js_trim(line)
    return t.startswith("[") & t.endswith("]")


EXTRACTORS: list[Extractor] = [
    Extractor("csv", "TXT", lambda: F.lower("filename").endswith(".csv"), parse_line=csv_line),
    Extractor("tablerone_json", "JSON", lambda: F.col("has_export"), read=tablerone_tabs),
    Extractor(
        "onetab_ini",
        "TXT",
        lambda: _any_line(_bracketed) & _any_line(lambda x: js_trim(x).contains(" * ")),
        parse_line=onetab_line,
    ),
    Extractor("pipe", "TXT", lambda: _any_line(lambda x: x.contains(" | ")), parse_line=pipe_line),
    Extractor(
        "dash",
        "TXT",
        lambda: _any_line(
            lambda x: x.contains(" - ") & has_web_scheme(js_trim(F.substring_index(x, " - ", -1)))
        ),
        parse_line=dash_line,
    ),
    Extractor(
        "bookmarks_html",
        "TXT",
        lambda: F.col("has_netscape")
        | (_any_line(lambda x: x.rlike("(?i)<DL>")) & _any_line(lambda x: x.rlike(r"(?i)<A\s+HREF="))),
        read=bookmarks,
    ),
    Extractor("url_only", "TXT", lambda: F.lit(True), parse_line=url_line),
    Extractor("json_array", "JSON", lambda: F.lit(True), read=json_array_items),
]


def without_cr(line: Column) -> Column:
    return F.regexp_replace(line, "\r$", "")


def profile_files(lines: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """One row per file: type, line and character counts, header, and the first non-blank lines.

    ``types`` may give ``filename, type`` decided earlier, which wins over sniffing.
    """
    # The rank filter prunes before the shuffle, so a file of any size sends a few lines per task.
    nth = F.row_number().over(W.partitionBy("filename").orderBy("pos"))
    sniff = (
        lines.filter(~is_blank(F.col("line")))
        .withColumn("__nth", nth)
        .filter(F.col("__nth") <= SNIFF_LINES)
        .groupBy("filename")
        .agg(F.array_sort(F.collect_list(F.struct("pos", without_cr(F.col("line")).alias("line"))))["line"].alias("sniff"))
    )
    head_line = F.when(F.col("pos") <= SNIFF_HEAD, F.struct("pos", F.left("line", F.lit(SNIFF_HEAD)).alias("line")))
    totals = lines.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("line") + 1).alias("chars"),
        F.bool_or(F.lower("line").contains("netscape-bookmark")).alias("has_netscape"),
        F.max(F.when(F.col("pos") == 0, without_cr(F.col("line")))).alias("header"),
        F.array_join(F.array_sort(F.collect_list(head_line))["line"], "\n").alias("__head"),
    )
    files = totals.join(sniff, "filename", "left").withColumn(
        "sniff", F.coalesce("sniff", F.array().cast("array<string>"))
    )
    if types is None:
        files = files.withColumn("__given", F.lit(None).cast("string"))
    else:
        files = files.join(types.select("filename", F.col("type").alias("__given")), "filename", "left")
    head = F.left("__head", F.lit(SNIFF_HEAD))
    return files.withColumn("type", source_type(F.col("filename"), head, F.col("__given"))).drop("__head", "__given")


def source_type(filename: Column, head: Column, given: Column) -> Column:
    """TXT or JSON: a given type, then the base name, then the first characters, then the suffix."""
    base = F.regexp_extract(filename, r"([^/\\]*)$", 1)
    return (
        F.when(given.isNotNull(), given)
        .when(base.rlike("(?i)tablerone"), "JSON")
        .when(head.rlike(rf"^[{JS_SPACE}]*[\[{{]"), "JSON")
        .when(F.lower(filename).endswith(".json"), "JSON")
        .otherwise("TXT")
    )


def _of_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The lines of some files; their text is not shuffled unless the names are too many to send."""
    names = files.select("filename")
    if names.count() <= BROADCAST_FILES:
        return lines.join(F.broadcast(names), "filename", "left_semi")
    return semi_by_key(lines, names, "filename", F.col("pos"))


def read_json(lines: DataFrame, profile: DataFrame, size: int = BLOCK) -> JsonScan:
    """The JSON files of a profile, read by records; pass it on to what follows, so that they are read once."""
    return scan_json(_of_files(lines, profile.filter("type = 'JSON'")), size)


def detect_formats(
    lines: DataFrame, types: DataFrame | None = None, extractors: list[Extractor] = EXTRACTORS, size: int = BLOCK
) -> DataFrame:
    """File profiles with ``format`` and ``error``."""
    return read_formats(lines, types, extractors, size)[0]


def read_formats(
    lines: DataFrame, types: DataFrame | None = None, extractors: list[Extractor] = EXTRACTORS, size: int = BLOCK
) -> tuple[DataFrame, JsonScan]:
    """File profiles with ``format`` and ``error`` (NULL but for JSON that no parser takes), and the scan of the JSON files."""
    profile = cut_lineage(profile_files(lines, types))
    scan = read_json(lines, profile, size)
    seen = scan.verdicts.select(
        "filename", "valid", (F.col("valid") & (F.col("root") == "{") & (F.col("exported") >= 0)).alias("has_export")
    )
    files = profile.join(seen, "filename", "left").withColumn("has_export", F.coalesce("has_export", F.lit(False)))
    chosen = F.lit(None).cast("string")
    for e in reversed(extractors):
        chosen = F.when((F.col("type") == e.type) & e.detect(), e.format).otherwise(chosen)
    error = F.when((F.col("type") == "JSON") & ~F.col("valid"), F.lit("not valid JSON"))
    return cut_lineage(files.withColumns({"format": chosen, "error": error}).drop("valid")), scan


def extract_links(
    lines: DataFrame,
    profile: DataFrame,
    extractors: list[Extractor] = EXTRACTORS,
    scan: JsonScan | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """``filename, type, format, pos, url, title`` of the files of ``profile``, order-preserving through ``pos``.

    ``profile`` is read several times, best from a stored or kept table as ``read_formats`` gives;
    ``scan`` is what ``read_formats`` has read of the JSON files.
    """
    header = csv_fields(F.col("header"))
    is_csv = F.col("format") == "csv"
    facts = profile.select(
        "filename",
        "type",
        "format",
        "n",
        F.when(is_csv, F.array_position(header, "NavigatedToUrl")).alias("url_at"),
        F.when(is_csv, F.array_position(header, "PageTitle")).alias("title_at"),
    )
    by_line = [e for e in extractors if e.parse_line]
    link = F.lit(None).cast("struct<url:string,title:string>")
    for e in by_line:
        link = F.when(F.col("format") == e.format, e.parse_line(F.col("line"))).otherwise(link)
    out = (
        attach_by_key(lines, facts, "filename", F.col("pos"))
        .filter(F.col("format").isin([e.format for e in by_line]))
        .select("filename", "type", "format", "pos", F.inline(F.array_compact(F.array(link))))
    )
    present = {r["format"] for r in facts.select("format").distinct().collect()}  # at most one row an extractor
    for e in extractors:
        if e.read is None or e.format not in present:
            continue
        files = facts.filter(F.col("format") == e.format)
        if e.type == "JSON" and scan is None:
            scan = read_json(lines, facts, size)
        found = e.read(_of_files(lines, files), scan)
        found = found.filter(F.coalesce(has_web_scheme(F.col("url")), F.lit(False)))
        tagged = found.join(files.select("filename", "type", "format"), "filename")
        out = out.unionByName(tagged.select("filename", "type", "format", "pos", "url", "title"))
    return out
