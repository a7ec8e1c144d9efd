"""Link, source and log tables derived from the given Parquet tables.

Each has a Spark builder that runs the library's own ingest, and an SQL twin for the oracle. Derived
link tables are written once per session to the shared folder, as a user of the library would keep
them, so that queries read Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefmill.functions.urls import with_url_parts
from hrefmill.operators.dedup import dedup_execute
from hrefmill.operators.ingest import build_link_rows
from hrefmill.operators.transitions import change, filter_internal_execute
from hrefmill.plans.ordering import with_rank_in_group
from hrefmill.sources.files import lines_of
from hrefmill.storage import shared_dir

_saved: dict[tuple[str, str, str], str] = {}


def saved_path(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> str:
    """Folder of a derived table, written on first use in this session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _saved:
        slug = sf_dir.strip("/").replace("/", "_")
        path = f"{shared_dir(spark)}/hrefmill/{key[0]}/{slug}/{name}"
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
        _saved[key] = path
    return _saved[key]


def saved(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    return spark.read.parquet(saved_path(spark, sf_dir, name, build))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", "url", F.trim(F.regexp_replace(title, "[^A-Za-z0-9 ]", "")).alias("t")
    )


def raw_links(pages_df: DataFrame) -> DataFrame:
    """``seq url title`` with near copies, private hosts and malformed URLs, in one pass."""
    n, url = F.col("page_id"), F.col("url")
    open_end = ~url.rlike("[?#]")
    variants = {
        0: (F.lit(True), url),
        1: (n % 5 == 0, F.regexp_replace(url, "^(https?://)(www[.])?", "$1www.")),
        2: ((n % 7 == 0) & open_end & ~url.endswith("/"), F.concat(url, F.lit("/"))),
        3: (n % 11 == 0, url),
        4: (n % 13 == 0, F.concat(F.lit("http://10.0."), n % 256, F.lit(".1/wiki/"), n)),
        5: (n % 17 == 0, F.concat(F.lit("http://bad host "), n)),
        6: ((n % 19 == 0) & open_end, F.concat(url, F.lit("?z=1&b=2&a=3"))),
        7: (n % 23 == 0, F.regexp_replace(url, "^http(s?)://([^/?#]+)", "HTTP$1://$2:80")),
    }
    rows = F.array_compact(
        F.array(*[F.when(c, F.struct((n * 10 + k).alias("seq"), u.alias("url"))) for k, (c, u) in variants.items()])
    )
    return pages_df.select(F.inline(rows), F.col("t").alias("title"))


def build_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_links(pages(spark, sf_dir)).withColumns(
        {
            "type": F.lit("TXT"),
            "strategy": F.lit("normalized"),
            "source_file": F.concat(F.lit("f"), F.col("seq") % 8, F.lit(".txt")),
        }
    )
    ranked = with_rank_in_group(raw, "source_file", "seq", "source_order")
    created = F.timestamp_seconds(F.col("seq") + 1704067200)
    return build_link_rows(with_url_parts(ranked, "url"), created)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "links", build_links)


def build_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = filter_internal_execute(dedup_execute(links(spark, sf_dir)))
    return change(cleaned, F.col("seq") % 6 == 0, {"tags": F.array(F.lit("saved"))})


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links after deduplication, internal filtering and some tagging."""
    return saved(spark, sf_dir, "curated", build_curated)


def build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, content``: eight kinds of export files, ten links each, as many as pages need."""
    p = pages(spark, sf_dir).withColumns({"k": F.col("page_id") % 7, "g": F.floor(F.col("page_id") / 70)})
    url, t, q = F.col("url"), F.col("t"), F.lit('"')
    entry = F.concat(F.lit('{"url":"'), url, F.lit('","title":"'), t, F.lit('"}'))
    cases = [
        (0, "urls_", ".txt", url),
        (1, "pipe_", ".txt", F.concat(url, F.lit(" | "), t)),
        (2, "dash_", ".txt", F.concat(t, F.lit(" - "), url)),
        (3, "onetab_", ".txt", F.concat(url, F.lit(" * "), t)),
        (4, "history_", ".csv", F.concat(url, F.lit(","), q, t, q)),
        (5, "flat_", ".json", entry),
        (5, "tablerone_backup_", ".txt", entry),
        (6, "bookmarks_", ".html", F.concat(F.lit('<DT><A HREF="'), url, F.lit('">'), t, F.lit(" &amp; more</A>"))),
    ]
    rows = F.array_compact(
        F.array(
            *[
                F.when(F.col("k") == k, F.struct(F.lit(stem).alias("stem"), F.lit(ext).alias("ext"), v.alias("v")))
                for k, stem, ext, v in cases
            ]
        )
    )
    # Ten pages of one kind fall into one file, so a group never holds more than ten rows.
    body = F.array_sort(F.collect_list(F.struct("page_id", "v")))["v"]
    files = p.select("page_id", "g", F.inline(rows)).groupBy("stem", "ext", "g").agg(body.alias("body"))
    nl = lambda a: F.array_join(a, "\n")
    b, stem = F.col("body"), F.col("stem")
    section = F.concat(F.lit("[Group "), F.col("g").cast("string"), F.lit("]"))
    content = (
        F.when(stem == "onetab_", nl(F.concat(F.slice(b, 1, 1), F.array(section), F.slice(b, F.lit(2), F.size(b)))))
        .when(stem == "history_", F.concat(F.lit("NavigatedToUrl,PageTitle\n"), nl(b)))
        .when(stem == "flat_", F.concat(F.lit("["), F.array_join(b, ","), F.lit("]")))
        .when(stem == "tablerone_backup_", F.concat(F.lit('{"export":[{"tabs":['), F.array_join(b, ","), F.lit("]}]}")))
        .when(stem == "bookmarks_", F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1>\n<DL>\n"), nl(b), F.lit("\n</DL>")))
        .otherwise(nl(b))
    )
    return files.select(F.concat(stem, F.col("g").cast("string"), F.col("ext")).alias("filename"), content.alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "sources", build_sources)


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(sources(spark, sf_dir))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, pos, line`` of three documents that hold all pages, records broken over lines."""
    p = pages(spark, sf_dir)
    n = _page_count(spark, sf_dir)
    k, q = F.col("page_id"), F.lit('"')
    url, t = F.concat(q, "url", q), F.concat(q, "t", q)
    comma = F.when(k == n - 1, "").otherwise(",")
    opens = F.when(k % 10 == 0, '{"tabs":[').otherwise("")
    closes = F.when((k % 10 == 9) | (k == n - 1), F.concat(F.lit("]}"), comma)).otherwise(",")
    line = lambda name, pos, text: F.struct(F.lit(name).alias("filename"), pos.cast("bigint").alias("pos"), text.alias("line"))
    rows = F.array(
        line("long.json", 4 * k + 1, F.concat(F.lit(' {"url": '), url, F.lit(","))),
        line("long.json", 4 * k + 2, F.lit('  "title" :')),
        line("long.json", 4 * k + 3, t),
        line("long.json", 4 * k + 4, F.concat(F.lit("}"), comma)),
        line("tablerone_long.json", k + 1, F.concat(opens, F.lit('{"url":'), url, F.lit(',"title":'), t, F.lit("}"), closes)),
        line("long.html", 2 * k + 1, F.concat(F.lit("<DT><A HREF="), url)),
        line("long.html", 2 * k + 2, F.concat(F.lit('ADD="1">'), "t", F.lit(" &amp; more</A>"))),
    )
    ends = [("long.json", 0, "["), ("long.json", 4 * n + 1, "]"), ("tablerone_long.json", 0, '{"export":['), ("tablerone_long.json", n + 1, "]}")]
    ends.append(("long.html", 0, "<!DOCTYPE NETSCAPE-Bookmark-file-1>"))
    return p.select(F.inline(rows)).unionByName(spark.createDataFrame(ends, "filename string, pos long, line string"))


def source_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per source file; the strategy depends on the kind of file."""
    name = F.col("filename")
    strategy = F.when(name.startswith("pipe"), "smart").when(name.startswith("dash"), "strict").otherwise("normalized")
    kind = F.when(name.rlike("^(flat|tablerone)"), "JSON").otherwise("TXT")
    return sources(spark, sf_dir).select(
        "filename",
        F.regexp_extract("filename", "([0-9]+)", 1).cast("bigint").alias("job_seq"),
        kind.alias("type"),
        strategy.alias("strategy"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _page_count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").agg(F.max("page_id") + 1).first()[0]


def _linked(n: int) -> Column:
    return F.md5(((F.col("event_id") % n) * 10).cast("string"))


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _page_count(spark, sf_dir)
    failed = F.col("event_type") == "error"
    m = F.col("event_id") % 3
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        _linked(n).alias("link_id"),
        F.when(m == 0, "dns").when(m == 1, "head").otherwise("get").alias("method"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed & (F.col("user_id") % 3 == 0), "timeout after 10 s")
        .when(failed & (F.col("user_id") % 3 == 1), "connection refused")
        .alias("error"),
        F.floor(F.col("value") * 10).cast("bigint").alias("response_time"),
        F.col("ts").cast("timestamp").alias("completed_at"),
    )


def results_of_private_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test results, every second one of a link on a private host (``page_id * 10 + 4`` where there is one)."""
    n = _page_count(spark, sf_dir)
    e = F.col("event_id")
    number = (e % n) * 10 + F.when(e % 2 == 1, 4).otherwise(0)
    return test_results(spark, sf_dir).withColumnRenamed("id", "event_id").select(
        e.alias("id"), F.md5(number.cast("string")).alias("link_id"), "method", "status", "error", "response_time", "completed_at"
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "click", "manual_tag")
        .when(F.col("event_type") == "view", "deduplicate")
        .when(F.col("event_type") == "purchase", "filter_internal")
        .when(F.col("event_type") == "error", "filter_similar")
        .otherwise("import")
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("op_seq"),
        F.md5(F.concat(F.lit("op"), F.col("event_id"))).alias("id"),
        kind.alias("type"),
        F.when(kind == "import", F.concat(F.lit("job"), F.col("user_id"))).alias("job_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("user_id") * 10).alias("stats_input_count"),
        (F.col("user_id") * 9).alias("stats_output_count"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change per event: mostly status and title edits, a few additions."""
    n = _page_count(spark, sf_dir)
    e = F.col("event_id")
    added = F.col("event_type") == "signup"
    return events(spark, sf_dir).select(
        e.alias("op_seq"),
        _linked(n).alias("link_id"),
        F.when(added, "added").otherwise("modified").alias("kind"),
        F.when(~added, F.when(e % 2 == 0, "status").otherwise("title")).alias("field"),
        F.when(~added, F.concat(F.lit("old-"), e)).alias("before"),
        F.when(~added, F.concat(F.lit("new-"), e)).alias("after"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).filter(e % 50 == 7).select(
        F.concat(F.lit("snap"), e).alias("id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit('["a","b"'), F.when(e % 100 == 7, ',"c"').otherwise(""), F.lit("]")).alias("link_ids"),
    )


def stored_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with their changes as JSON text, the compact stored form."""
    n = _page_count(spark, sf_dir)
    link = _linked(n)
    edit = F.concat(
        F.lit('[{"id":"'), link, F.lit('","changes":{"status":{"before":"imported","after":"'),
        F.col("event_type"), F.lit('"}}}]'),
    )
    listed = F.concat(F.lit('["'), link, F.lit('"]'))
    kind = F.col("event_type")
    message = lambda text: F.concat(F.lit('[{"message":"'), F.lit(text), F.col("user_id"), F.lit('","linkId":"'), link, F.lit('"}]'))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("op_seq"),
        F.when(kind == "error", message("no answer ")).alias("errors"),
        F.when(kind == "click", F.concat(F.lit('[{"message":"twice"},'), F.substring(message("slow "), 2, 200))).otherwise("[]").alias("warnings"),
        F.when(kind == "signup", listed).otherwise("[]").alias("changes_added"),
        F.when(kind == "purchase", listed).otherwise("[]").alias("changes_removed"),
        F.when(kind.isin("signup", "purchase"), "[]").otherwise(edit).alias("changes_modified"),
    )


# --- SQL twins -------------------------------------------------------------------------------------

_PATTERN = r"^([A-Za-z]+)://([^/?#:\s]+)(?::([0-9]+))?([^?#\s]*)(?:[?]([^#\s]*))?(?:#([^\s]*))?$"

PAGES_SQL = """
p AS (
  SELECT page_id, url,
         trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9 ]', '', 'g')) AS t
  FROM pages
)"""

LINKS_SQL = (
    PAGES_SQL
    + rf""",
raw AS (
  SELECT page_id*10 AS seq, url AS u, t FROM p
  UNION ALL SELECT page_id*10+1, regexp_replace(url, '^(https?://)(www[.])?', '\1www.'), t FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT page_id*10+2, concat(url, '/'), t FROM p
            WHERE page_id % 7 = 0 AND NOT regexp_matches(url, '[?#]') AND NOT url LIKE '%/'
  UNION ALL SELECT page_id*10+3, url, t FROM p WHERE page_id % 11 = 0
  UNION ALL SELECT page_id*10+4, concat('http://10.0.', page_id % 256, '.1/wiki/', page_id), t FROM p WHERE page_id % 13 = 0
  UNION ALL SELECT page_id*10+5, concat('http://bad host ', page_id), t FROM p WHERE page_id % 17 = 0
  UNION ALL SELECT page_id*10+6, concat(url, '?z=1&b=2&a=3'), t FROM p
            WHERE page_id % 19 = 0 AND NOT regexp_matches(url, '[?#]')
  UNION ALL SELECT page_id*10+7, regexp_replace(url, '^http(s?)://([^/?#]+)', 'HTTP\1://\2:80'), t FROM p WHERE page_id % 23 = 0
),
cut AS (
  SELECT seq, u, t, regexp_matches(u, '{_PATTERN}') AS ok,
         lower(regexp_extract(u, '{_PATTERN}', 1)) AS scheme, lower(regexp_extract(u, '{_PATTERN}', 2)) AS host,
         regexp_extract(u, '{_PATTERN}', 3) AS port0,
         CASE WHEN regexp_extract(u, '{_PATTERN}', 4) = '' THEN '/' ELSE regexp_extract(u, '{_PATTERN}', 4) END AS path,
         regexp_extract(u, '{_PATTERN}', 5) AS query, regexp_extract(u, '{_PATTERN}', 6) AS frag
  FROM raw
),
bits AS (
  SELECT *, CASE WHEN port0 = '' OR (scheme = 'http' AND port0 = '80') OR (scheme = 'https' AND port0 = '443')
                 THEN '' ELSE ':' || port0 END AS port,
         CASE WHEN path = '/' THEN '/' ELSE regexp_replace(path, '/$', '') END AS slim
  FROM cut
),
links AS (
  SELECT seq, md5(CAST(seq AS VARCHAR)) AS id, u AS original_url,
         CASE WHEN ok THEN scheme || '://' || regexp_replace(host, '^www[.]', '') || port || slim ||
              CASE WHEN query = '' THEN '' ELSE '?' || query END ELSE u END AS normalized_url,
         CASE WHEN ok THEN host ELSE '' END AS domain,
         CASE WHEN ok THEN path END AS url_path,
         CASE WHEN ok THEN nullif(query, '') END AS url_query,
         CASE WHEN ok THEN nullif(frag, '') END AS url_hash,
         t AS title, 'TXT' AS source, concat('f', seq % 8, '.txt') AS source_file,
         row_number() OVER (PARTITION BY seq % 8 ORDER BY seq) - 1 AS source_order,
         'imported' AS status, '[]' AS tags, FALSE AS is_internal,
         CAST(NULL AS VARCHAR) AS similarity_group, CAST(NULL AS VARCHAR) AS duplicate_of,
         CASE WHEN ok THEN scheme || '://' || host || port || slim ||
              CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END
              ELSE u END AS dedup_key,
         CASE WHEN ok THEN scheme || '://' || regexp_replace(host, '^www[.]', '') || port || slim ||
              CASE WHEN query = '' THEN '' ELSE '?' || query END ||
              CASE WHEN frag = '' THEN '' ELSE '#' || frag END ELSE u END AS smart_key,
         regexp_matches(host, '^(10[.]|192[.]168[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.])')
           OR host IN ('localhost', '127.0.0.1') AS private
  FROM bits
)"""
)

CURATED_SQL = (
    LINKS_SQL
    + """,
marked AS (
  SELECT *, first_value(id) OVER (PARTITION BY dedup_key ORDER BY seq) AS keep_id FROM links
),
curated AS (
  SELECT * REPLACE (
           CASE WHEN id <> keep_id THEN 'duplicate_removed' WHEN private THEN 'filtered_internal' ELSE status END AS status,
           CASE WHEN seq % 6 = 0 THEN '["saved"]' ELSE '[]' END AS tags,
           (id = keep_id AND private) AS is_internal,
           CASE WHEN id <> keep_id THEN keep_id END AS duplicate_of)
  FROM marked
)"""
)

SOURCES_SQL = (
    PAGES_SQL
    + """,
kinds AS (
  SELECT page_id, page_id // 70 AS g, 'urls_' AS stem, '.txt' AS ext, url AS v FROM p WHERE page_id % 7 = 0
  UNION ALL SELECT page_id, page_id // 70, 'pipe_', '.txt', url || ' | ' || t FROM p WHERE page_id % 7 = 1
  UNION ALL SELECT page_id, page_id // 70, 'dash_', '.txt', t || ' - ' || url FROM p WHERE page_id % 7 = 2
  UNION ALL SELECT page_id, page_id // 70, 'onetab_', '.txt', url || ' * ' || t FROM p WHERE page_id % 7 = 3
  UNION ALL SELECT page_id, page_id // 70, 'history_', '.csv', url || ',"' || t || '"' FROM p WHERE page_id % 7 = 4
  UNION ALL SELECT page_id, page_id // 70, 'flat_', '.json', '{"url":"' || url || '","title":"' || t || '"}' FROM p WHERE page_id % 7 = 5
  UNION ALL SELECT page_id, page_id // 70, 'tablerone_backup_', '.txt', '{"url":"' || url || '","title":"' || t || '"}' FROM p WHERE page_id % 7 = 5
  UNION ALL SELECT page_id, page_id // 70, 'bookmarks_', '.html', '<DT><A HREF="' || url || '">' || t || ' &amp; more</A>' FROM p WHERE page_id % 7 = 6
),
bodies AS (
  SELECT stem, ext, g, list(v ORDER BY page_id) AS b FROM kinds GROUP BY stem, ext, g
),
sources AS (
  SELECT stem || CAST(g AS VARCHAR) || ext AS filename,
         CASE stem
           WHEN 'onetab_' THEN array_to_string(list_concat(list_concat(b[1:1], ['[Group ' || CAST(g AS VARCHAR) || ']']), b[2:]), chr(10))
           WHEN 'history_' THEN 'NavigatedToUrl,PageTitle' || chr(10) || array_to_string(b, chr(10))
           WHEN 'flat_' THEN '[' || array_to_string(b, ',') || ']'
           WHEN 'tablerone_backup_' THEN '{"export":[{"tabs":[' || array_to_string(b, ',') || ']}]}'
           WHEN 'bookmarks_' THEN '<!DOCTYPE NETSCAPE-Bookmark-file-1>' || chr(10) || '<DL>' || chr(10) || array_to_string(b, chr(10)) || chr(10) || '</DL>'
           ELSE array_to_string(b, chr(10)) END AS content
  FROM bodies
),
lines AS (
  SELECT filename, CAST(i - 1 AS BIGINT) AS pos, all_lines[i] AS line
  FROM (SELECT filename, all_lines, unnest(range(1, len(all_lines) + 1)) AS i
        FROM (SELECT filename, string_split(content, chr(10)) AS all_lines FROM sources))
)"""
)

LONG_SQL = (
    PAGES_SQL
    + """,
last AS (SELECT max(page_id) AS k FROM p),
long_lines AS (
  SELECT 'long.json' AS filename, 4 * page_id + i AS pos,
         CASE i WHEN 1 THEN ' {"url": "' || url || '",' WHEN 2 THEN '  "title" :' WHEN 3 THEN '"' || t || '"'
                ELSE '}' || CASE WHEN page_id = k THEN '' ELSE ',' END END AS line
  FROM p, last, range(1, 5) r(i)
  UNION ALL SELECT 'long.json', 0, '[' UNION ALL SELECT 'long.json', 4 * k + 5, ']' FROM last
  UNION ALL SELECT 'tablerone_long.json', page_id + 1,
         CASE WHEN page_id % 10 = 0 THEN '{"tabs":[' ELSE '' END || '{"url":"' || url || '","title":"' || t || '"}' ||
         CASE WHEN page_id = k THEN ']}' WHEN page_id % 10 = 9 THEN ']},' ELSE ',' END FROM p, last
  UNION ALL SELECT 'tablerone_long.json', 0, '{"export":[' UNION ALL SELECT 'tablerone_long.json', k + 2, ']}' FROM last
  UNION ALL SELECT 'long.html', 2 * page_id + 1, '<DT><A HREF="' || url || '"' FROM p
  UNION ALL SELECT 'long.html', 2 * page_id + 2, 'ADD="1">' || t || ' &amp; more</A>' FROM p
  UNION ALL SELECT 'long.html', 0, '<!DOCTYPE NETSCAPE-Bookmark-file-1>'
)"""
)

# Detection from content and name alone, then one SELECT per format.
EXTRACTED_SQL = (
    SOURCES_SQL
    + r""",
sniffed AS (
  SELECT filename,
         bool_or(starts_with(trim(line), '[') AND ends_with(trim(line), ']')) AS has_section,
         bool_or(contains(trim(line), ' * ')) AS has_star,
         bool_or(contains(line, ' | ')) AS has_pipe,
         bool_or(regexp_matches(line, '.* - https?://')) AS has_dash,
         bool_or(regexp_matches(line, '(?i)<DL>')) AND bool_or(regexp_matches(line, '(?i)<A\s+HREF=')) AS has_anchor
  FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY pos) AS rn FROM lines WHERE trim(line) <> '')
  WHERE rn <= 10 GROUP BY filename
),
typed AS (
  SELECT filename, content,
         CASE WHEN regexp_matches(filename, '(?i)tablerone') THEN 'JSON'
              WHEN regexp_matches(left(content, 64), '^\s*[\[{]') THEN 'JSON'
              WHEN ends_with(lower(filename), '.json') THEN 'JSON' ELSE 'TXT' END AS type
  FROM sources
),
formats AS (
  SELECT filename, type, content,
         CASE WHEN type = 'TXT' AND ends_with(lower(filename), '.csv') THEN 'csv'
              WHEN type = 'JSON' AND json_valid(content) AND json_type(content, '$.export') = 'ARRAY' THEN 'tablerone_json'
              WHEN type = 'JSON' THEN 'json_array'
              WHEN has_section AND has_star THEN 'onetab_ini'
              WHEN has_pipe THEN 'pipe'
              WHEN has_dash THEN 'dash'
              WHEN contains(lower(content), 'netscape-bookmark') OR has_anchor THEN 'bookmarks_html'
              ELSE 'url_only' END AS format
  FROM typed LEFT JOIN sniffed USING (filename)
),
tagged AS (SELECT filename, type, format, pos, trim(line) AS line FROM lines JOIN formats USING (filename)),
extracted AS (
  SELECT filename, type, format, pos, line AS url, '' AS title FROM tagged
  WHERE format = 'url_only' AND regexp_matches(line, '^https?://')
  UNION ALL
  SELECT filename, type, format, pos, trim(regexp_extract(line, '^(.*?) \| ', 1)), trim(regexp_extract(line, '^.*? \| (.*)$', 1))
  FROM tagged WHERE format = 'pipe' AND regexp_matches(line, '^https?://.* \| ')
  UNION ALL
  SELECT filename, type, format, pos,
         CASE WHEN contains(line, ' - ') THEN trim(regexp_extract(line, '^.* - (.*)$', 1)) ELSE line END,
         CASE WHEN contains(line, ' - ') THEN trim(regexp_extract(line, '^(.*) - ', 1)) ELSE '' END
  FROM tagged WHERE format = 'dash' AND regexp_matches(line, '(^|.* - )https?://')
  UNION ALL
  SELECT filename, type, format, pos, trim(regexp_extract(line, '^(.*?) \* ', 1)), trim(regexp_extract(line, '^.*? \* (.*)$', 1))
  FROM tagged WHERE format = 'onetab_ini' AND regexp_matches(line, '^https?://.* \* ')
  UNION ALL
  SELECT filename, type, format, pos, regexp_extract(line, '^([^,]*),', 1), regexp_extract(line, ',"(.*)"$', 1)
  FROM tagged WHERE format = 'csv' AND pos > 0 AND regexp_matches(line, '^https?://')
  UNION ALL
  SELECT filename, type, format, CAST(i AS BIGINT), json_extract_string(content, '$[' || i || '].url'),
         coalesce(json_extract_string(content, '$[' || i || '].title'), '')
  FROM (SELECT *, unnest(range(CAST(json_array_length(content) AS BIGINT))) AS i FROM formats WHERE format = 'json_array')
  UNION ALL
  SELECT filename, type, format, CAST(i AS BIGINT), json_extract_string(content, '$.export[0].tabs[' || i || '].url'),
         coalesce(json_extract_string(content, '$.export[0].tabs[' || i || '].title'), '')
  FROM (SELECT *, unnest(range(CAST(json_array_length(content, '$.export[0].tabs') AS BIGINT))) AS i FROM formats WHERE format = 'tablerone_json')
  UNION ALL
  SELECT filename, type, format, CAST(i - 1 AS BIGINT), urls[i], replace(titles[i], '&amp;', '&')
  FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS i
        FROM (SELECT *, regexp_extract_all(content, '(?i)<A\s+HREF="([^"]+)"[^>]*>([^<]*)</A>', 1) AS urls,
                     regexp_extract_all(content, '(?i)<A\s+HREF="([^"]+)"[^>]*>([^<]*)</A>', 2) AS titles
              FROM formats WHERE format = 'bookmarks_html'))
)"""
)

_LINKED = "md5(CAST((event_id % (SELECT max(page_id) + 1 FROM pages)) * 10 AS VARCHAR))"

RESULTS_SQL = f"""
results AS (
  SELECT event_id AS id, {_LINKED} AS link_id,
         CASE event_id % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'head' ELSE 'get' END AS method,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'timeout after 10 s'
              WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'connection refused' END AS error,
         CAST(floor(value * 10) AS BIGINT) AS response_time, ts AS completed_at
  FROM events
)"""

PRIVATE_RESULTS_SQL = """
results AS (
  SELECT event_id AS id,
         md5(CAST((event_id % (SELECT max(page_id) + 1 FROM pages)) * 10 + CASE WHEN event_id % 2 = 1 THEN 4 ELSE 0 END AS VARCHAR)) AS link_id
  FROM events
)"""

OPERATIONS_SQL = """
operations AS (
  SELECT event_id AS op_seq, md5('op' || CAST(event_id AS VARCHAR)) AS id,
         CASE event_type WHEN 'click' THEN 'manual_tag' WHEN 'view' THEN 'deduplicate' WHEN 'purchase' THEN 'filter_internal'
              WHEN 'error' THEN 'filter_similar' ELSE 'import' END AS type,
         CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'error') THEN 'job' || CAST(user_id AS VARCHAR) END AS job_id,
         ts AS timestamp, user_id * 10 AS stats_input_count, user_id * 9 AS stats_output_count
  FROM events
)"""

CHANGES_SQL = f"""
changes AS (
  SELECT event_id AS op_seq, {_LINKED} AS link_id,
         CASE WHEN event_type = 'signup' THEN 'added' ELSE 'modified' END AS kind,
         CASE WHEN event_type <> 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'status' ELSE 'title' END END AS field,
         CASE WHEN event_type <> 'signup' THEN 'old-' || CAST(event_id AS VARCHAR) END AS before,
         CASE WHEN event_type <> 'signup' THEN 'new-' || CAST(event_id AS VARCHAR) END AS after
  FROM events
)"""

SNAPSHOTS_SQL = """
snapshots AS (
  SELECT 'snap' || CAST(event_id AS VARCHAR) AS id, ts AS created_at,
         CASE WHEN event_id % 100 = 7 THEN 3 ELSE 2 END AS link_count
  FROM events WHERE event_id % 50 = 7
)"""
