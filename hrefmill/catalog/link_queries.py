"""Scans, searches, counts and pages over the link table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hrefmill.catalog import fixtures as fx
from hrefmill.catalog.registry import query, text
from hrefmill.functions import urls
from hrefmill.operators import ingest, listing, search, stats

L, C = fx.LINKS_SQL, fx.CURATED_SQL
ACTIVE = "status NOT IN ('duplicate_removed', 'filtered_internal', 'filtered_similar')"
NEWEST = "ORDER BY seq DESC"


def _tags_as_text(df):
    return df.withColumn("tags", F.to_json("tags"))


@query(
    "A4_scan_links",
    text(L, "SELECT seq, id, original_url, normalized_url, domain, url_path, url_query, url_hash, title, source, source_file, source_order, status, tags, is_internal, similarity_group, duplicate_of FROM links"),
)
def scan_links(spark, sf):
    return _tags_as_text(fx.links(spark, sf)).drop("created_at", "updated_at")


@query("A4_all_ids", text(L, "SELECT id FROM links"))
def all_ids(spark, sf):
    return fx.links(spark, sf).select("id")


@query("A5_scan_active_links", text(C, f"SELECT id, seq, original_url, normalized_url, domain FROM curated WHERE {ACTIVE}"))
def scan_active(spark, sf):
    return listing.scan_active_links(fx.curated(spark, sf))


@query("A19_partition_valid", text(L, "SELECT seq, u AS url, ok AS is_valid FROM cut"))
def partition_valid(spark, sf):
    raw = fx.raw_links(fx.pages(spark, sf))
    return ingest.with_validity(raw).select("seq", "url", "is_valid")


@query("A20_build_link_rows", text(L, "SELECT id, normalized_url, domain, url_path, url_query, url_hash, status, is_internal FROM links"))
def build_rows(spark, sf):
    return fx.build_links(spark, sf).select(
        "id", "normalized_url", "domain", "url_path", "url_query", "url_hash", "status", "is_internal"
    )


@query(
    "C1_url_parts",
    text(L, """SELECT seq, CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN host END AS host,
                      CASE WHEN ok THEN nullif(substr(port, 2), '') END AS port, CASE WHEN ok THEN path END AS path,
                      CASE WHEN ok THEN CASE WHEN query = '' THEN '' ELSE '?' || query END END AS search,
                      CASE WHEN ok THEN CASE WHEN frag = '' THEN '' ELSE '#' || frag END END AS hash FROM bits"""),
)
def url_parts(spark, sf):
    raw = fx.raw_links(fx.pages(spark, sf)).select("seq", "url")
    parts = ["scheme", "host", "port", "path", "search", "hash"]
    return urls.with_url_parts(raw, "url").select("seq", *[F.col(f"u_{p}").alias(p) for p in parts])


@query("C2_extract_domain", text(L, "SELECT id, domain FROM links"))
def extract_domain(spark, sf):
    raw = fx.raw_links(fx.pages(spark, sf))
    return urls.with_url_parts(raw, "url").select(
        F.md5(F.col("seq").cast("string")).alias("id"), F.coalesce("u_host", F.lit("")).alias("domain")
    )


_FLAGS = {
    "C3a_force_https": (
        urls.NormalizeConfig(force_https=True),
        "'https://' || host || CASE WHEN port IN ('', ':443') THEN '' ELSE port END || path || q || f",
    ),
    "C3b_remove_www": (urls.NormalizeConfig(remove_www=True), "scheme || '://' || regexp_replace(host, '^www[.]', '') || port || path || q || f"),
    "C3c_remove_trailing_slash": (urls.NormalizeConfig(remove_trailing_slash=True), "scheme || '://' || host || port || slim || q || f"),
    "C3d_remove_default_port": (urls.NormalizeConfig(remove_default_port=True), "scheme || '://' || host || port || path || q || f"),
    "C3e_sort_query_params": (
        urls.NormalizeConfig(sort_query_params=True),
        "scheme || '://' || host || port || path || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END || f",
    ),
    "C3f_remove_fragment": (urls.NormalizeConfig(remove_fragment=True), "scheme || '://' || host || port || path || q"),
}


def _register_flag(name, config, expression):
    sql = text(
        L,
        f"""SELECT seq, CASE WHEN ok THEN {expression} ELSE u END AS url FROM
            (SELECT *, CASE WHEN query = '' THEN '' ELSE '?' || query END AS q, CASE WHEN frag = '' THEN '' ELSE '#' || frag END AS f FROM bits)""",
    )

    @query(name, sql)
    def run(spark, sf):
        raw = fx.raw_links(fx.pages(spark, sf)).select("seq", "url")
        parsed = urls.with_url_parts(raw, "url")
        return parsed.select("seq", urls.normalized("u_", config, F.col("url")).alias("url"))


for _name, (_config, _expression) in _FLAGS.items():
    _register_flag(_name, _config, _expression)


@query(
    "C4_strategy_presets",
    text(L, "SELECT id, original_url AS strict, smart_key AS smart, normalized_url AS import_normalized, dedup_key AS dedup_normalized FROM links"),
)
def presets(spark, sf):
    df = fx.links(spark, sf).select("id", "original_url", "domain", "url_path", "url_query", "url_hash")
    for name in urls.PRESETS:
        df = urls.with_dedup_key(df, name, name)
    return df.select("id", *urls.PRESETS)


@query("C5_is_private_host", text(L, "SELECT domain, bool_or(private) AS private FROM links GROUP BY domain"))
def private_hosts(spark, sf):
    return fx.links(spark, sf).select("domain").distinct().withColumn("private", urls.is_private_host(F.col("domain")))


@query("C6_is_internal_url", text(L, "SELECT id, private AS internal FROM links"))
def internal_urls(spark, sf):
    return fx.links(spark, sf).select("id", urls.is_private_host(F.col("domain")).alias("internal"))


@query("D1_links_by_status", text(C, "SELECT id, original_url, duplicate_of FROM curated WHERE status = 'duplicate_removed'"))
def by_status(spark, sf):
    return listing.links_by_status(fx.curated(spark, sf), "duplicate_removed").select("id", "original_url", "duplicate_of")


@query("D2_links_by_ids", text(C, "SELECT id, original_url FROM curated WHERE id IN (SELECT md5(CAST(page_id * 10 AS VARCHAR)) FROM pages)"))
def by_ids(spark, sf):
    ids = spark.read.parquet(f"{sf}/pages.parquet").select(F.md5((F.col("page_id") * 10).cast("string")).alias("id"))
    return listing.links_by_ids(fx.curated(spark, sf), ids).select("id", "original_url")


@query("D3_links_by_domains", text(C, "SELECT id, domain FROM curated WHERE domain = '' OR domain IN (SELECT domain FROM curated WHERE domain <> '' GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 2)"))
def by_domains(spark, sf):
    links = fx.curated(spark, sf)
    biggest = links.filter("domain <> ''").groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(2)
    wanted = biggest.select("domain").unionByName(links.filter("domain = ''").select("domain").distinct())
    return listing.links_by_domains(links, wanted).select("id", "domain")


@query("D4_duplicate_links", text(C, "SELECT id, duplicate_of FROM curated WHERE duplicate_of IS NOT NULL"))
def duplicates(spark, sf):
    return listing.duplicate_links(fx.curated(spark, sf)).select("id", "duplicate_of")


@query("D5_internal_links", text(C, "SELECT id, original_url FROM curated WHERE is_internal"))
def internals(spark, sf):
    return listing.internal_links(fx.curated(spark, sf)).select("id", "original_url")


def _like(column: str, value: str) -> str:
    return f"coalesce({column} ILIKE '%{value}%' ESCAPE '\x01', FALSE)"


def _parts_sql(columns: list[str], value: str) -> str:
    tests = [_like(c, value) for c in columns] + [f"(url_path IS NULL AND {_like('original_url', value)})"]
    return "(" + " OR ".join(tests) + ")"


ALL_PARTS = ["domain", "url_path", "url_query", "url_hash"]
FREE = ["original_url", "normalized_url", "domain", "title", "tags"]


@query("D6_search_free_text", text(C, "SELECT id FROM curated WHERE " + " OR ".join(_like(c, "The E") for c in FREE)))
def free_text(spark, sf):
    return search.search_links(fx.curated(spark, sf), "The E").select("id")


@query("D6_search_wildcards", text(C, "SELECT id FROM curated WHERE " + " OR ".join(_like(c, "en/_2%.html") for c in FREE)))
def wildcards(spark, sf):
    return search.search_links(fx.curated(spark, sf), "en/_2%.html").select("id")


@query(
    "D8_search_components",
    text(
        C,
        f"""SELECT id FROM curated
            WHERE ({_parts_sql(['domain'], 'blog')} OR {_parts_sql(['domain'], 'M.TH')})
              AND {_parts_sql(['url_path'], 'en')} AND {_parts_sql(ALL_PARTS, '5')}""",
    ),
)
def components(spark, sf):
    return search.search_links(fx.curated(spark, sf), "host:blog HOST:M.TH path:en 5").select("id")


@query("D9_search_malformed", text(C, f"SELECT id FROM curated WHERE {_parts_sql(['url_hash'], 'bad')}"))
def malformed(spark, sf):
    return search.search_links(fx.curated(spark, sf), "hash:bad").select("id")


@query("D10_search_narrowed", text(C, f"SELECT id FROM curated WHERE {_parts_sql(['url_path', 'url_hash'], 'top')} AND {_parts_sql(['url_path', 'url_hash'], 'en')}"))
def narrowed(spark, sf):
    return search.search_links(fx.curated(spark, sf), "top en", parts=["path", "hash"]).select("id")


@query("D11_search_page", text(C, f"SELECT id, seq FROM curated WHERE status = 'imported' AND {_parts_sql(['domain'], 'th')} {NEWEST} LIMIT 50 OFFSET 10"))
def search_page(spark, sf):
    hits = search.search_links(fx.curated(spark, sf), "host:th", status="imported")
    return listing.page(hits, 50, 10).select("id", "seq")


@query("D11_search_count", text(C, f"SELECT count(*) AS total FROM curated WHERE status = 'imported' AND {_parts_sql(['domain'], 'th')}"))
def search_count(spark, sf):
    return search.search_count(fx.curated(spark, sf), "host:th", status="imported")


@query("D13_resolved_urls", text(C, f"SELECT DISTINCT original_url AS url FROM curated WHERE {ACTIVE}"))
def resolved(spark, sf):
    return listing.resolved_urls(fx.curated(spark, sf))


@query("F1_count_links", text(C, "SELECT count(*) AS total FROM curated"))
def count_links(spark, sf):
    return stats.count_rows(fx.curated(spark, sf))


@query("F2_status_counts", text(C, "SELECT status, count(*) AS links FROM curated GROUP BY ROLLUP (status)"))
def status_counts(spark, sf):
    return stats.status_counts(fx.curated(spark, sf))


@query(
    "F3_status_breakdown",
    text(C, """SELECT coalesce(c.status, h.status) AS status, coalesce(links, 0) AS links, h.status IS NOT NULL AS highlighted
               FROM (SELECT status, count(*) AS links FROM curated GROUP BY status) c
               FULL JOIN (VALUES ('imported'), ('success'), ('pending')) h(status) ON c.status = h.status"""),
)
def status_breakdown(spark, sf):
    return stats.status_breakdown(fx.curated(spark, sf))


@query("F4_domain_counts", text(C, "SELECT domain, count(*) AS links FROM curated GROUP BY domain"))
def domain_counts(spark, sf):
    return stats.domain_counts(fx.curated(spark, sf))


@query("F5_resolved_url_count", text(C, f"SELECT count(DISTINCT original_url) AS resolved FROM curated WHERE {ACTIVE}"))
def resolved_count(spark, sf):
    return stats.resolved_url_count(fx.curated(spark, sf))


@query("F14_internal_preview", text(L, "SELECT count(*) FILTER (WHERE private) AS filtered_count, count(*) FILTER (WHERE NOT private) AS remaining_count FROM links"))
def internal_preview(spark, sf):
    return stats.internal_preview(fx.links(spark, sf))


@query("F14_internal_ids", text(L, "SELECT id FROM links WHERE private"))
def internal_ids(spark, sf):
    return stats.internal_ids(fx.links(spark, sf))


@query(
    "F14_internal_preview_of_ids",
    text(C, "SELECT count(*) FILTER (WHERE private) AS filtered_count, count(*) FILTER (WHERE NOT private) AS remaining_count FROM curated WHERE seq % 3 = 1"),
)
def internal_preview_of_ids(spark, sf):
    """Named links, whatever their status."""
    links = fx.curated(spark, sf)
    return stats.internal_preview(links, ids=links.filter("seq % 3 = 1"))


@query("F14_internal_ids_of_ids", text(C, "SELECT id FROM curated WHERE private AND seq % 3 = 1"))
def internal_ids_of_ids(spark, sf):
    links = fx.curated(spark, sf)
    return stats.internal_ids(links, ids=links.filter("seq % 3 = 1"))


@query(
    "F1_count_tables",
    text(C, """SELECT 'links' AS name, count(*) AS total FROM curated UNION ALL SELECT 'operations', count(*) FROM operations
               UNION ALL SELECT 'snapshots', count(*) FROM snapshots UNION ALL SELECT 'test_results', count(*) FROM results
               UNION ALL SELECT 'import_jobs', count(*) FROM sources""", fx.OPERATIONS_SQL, fx.SNAPSHOTS_SQL, fx.RESULTS_SQL, fx.SOURCES_SQL.removeprefix(fx.PAGES_SQL + ",")),
)
def count_tables(spark, sf):
    return stats.table_counts(
        {
            "links": fx.curated(spark, sf), "operations": fx.operations(spark, sf), "snapshots": fx.snapshots(spark, sf),
            "test_results": fx.test_results(spark, sf), "import_jobs": fx.source_jobs(spark, sf),
        }
    )


@query(
    "F5_sketched_url_count",
    text(C, f"""SELECT 'all' AS files, count(*) AS links, count(DISTINCT original_url) AS resolved, TRUE AS close FROM curated WHERE {ACTIVE}
                UNION ALL SELECT 'some', count(*), count(DISTINCT original_url), TRUE FROM curated WHERE {ACTIVE} AND source_file IN ('f1.txt', 'f2.txt', 'f5.txt')"""),
)
def sketched_count(spark, sf):
    """Sketches of all files, and of a choice of them, within four standard errors of the exact count beside them."""
    links = fx.curated(spark, sf)
    sketches = fx.saved(spark, sf, "url_sketches", lambda spark, sf: stats.url_sketches(fx.curated(spark, sf)))
    out = None
    for name, chosen in (("all", F.lit(True)), ("some", F.col("source_file").isin("f1.txt", "f2.txt", "f5.txt"))):
        guess = stats.sketched_url_count(sketches.filter(chosen)).withColumnRenamed("resolved", "guess")
        row = guess.crossJoin(stats.resolved_url_count(links.filter(chosen)))
        close = F.abs(F.col("guess") - F.col("resolved")) <= F.col("resolved") * (4 * 1.04 / 2 ** (stats.SKETCH_BITS / 2)) + 1
        row = row.select(F.lit(name).alias("files"), "links", "resolved", close.alias("close"))
        out = row if out is None else out.unionByName(row)
    return out


def _ordered(df, *columns):
    """The place of each row in the order of the result, as a column: a twin then checks the order too."""
    shown = df.select(*columns).collect()  # a page of the result, as a caller would show it
    schema = ", ".join(f"{n} {t}" for n, t in df.select(*columns).dtypes)
    return df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(shown)], f"place long, {schema}")


@query(
    "D13_resolved_in_order",
    text(C, f"SELECT row_number() OVER (ORDER BY original_url) - 1 AS place, original_url AS url FROM (SELECT DISTINCT original_url FROM curated WHERE {ACTIVE}) ORDER BY 1 LIMIT 40"),
)
def resolved_in_order(spark, sf):
    return _ordered(listing.resolved_page(fx.curated(spark, sf), 40), "url")


@query(
    "F4_domains_in_order",
    text(C, "SELECT row_number() OVER (ORDER BY links DESC, domain) - 1 AS place, domain, links FROM (SELECT domain, count(*) AS links FROM curated GROUP BY domain) ORDER BY 1 LIMIT 40"),
)
def domains_in_order(spark, sf):
    return _ordered(stats.domain_counts(fx.curated(spark, sf)).limit(40), "domain", "links")


@query(
    "H1_page_with_total",
    text(C, f"SELECT row_number() OVER ({NEWEST}) - 101 AS place, id, seq, (SELECT count(*) FROM curated) AS total FROM curated {NEWEST} LIMIT 50 OFFSET 100"),
)
def page_with_total(spark, sf):
    return _ordered(listing.page_with_total(fx.curated(spark, sf), 50, 100), "id", "seq", "total")


@query("H2_sample_operations", text(fx.OPERATIONS_SQL, "SELECT op_seq, type, job_id FROM operations ORDER BY timestamp DESC, op_seq DESC LIMIT 10"))
def sample_operations(spark, sf):
    return listing.sample_of(fx.operations(spark, sf), "timestamp", ["op_seq", "type", "job_id"])


@query("H2_sample_snapshots", text(fx.SNAPSHOTS_SQL, "SELECT id FROM snapshots ORDER BY created_at DESC, id DESC LIMIT 10"))
def sample_snapshots(spark, sf):
    return listing.sample_of(fx.snapshots(spark, sf), "created_at", ["id"])


@query("H2_sample_jobs", text(fx.SOURCES_SQL, "SELECT CAST(regexp_extract(filename, '([0-9]+)', 1) AS BIGINT) AS job_seq, filename FROM sources ORDER BY 1 DESC, filename DESC LIMIT 10"))
def sample_jobs(spark, sf):
    return listing.sample_of(fx.source_jobs(spark, sf), "job_seq", ["filename", "job_seq"]).select("job_seq", "filename")


@query("F17_links_per_source_file", text(C, "SELECT source_file, count(*) AS links FROM curated GROUP BY source_file"))
def per_source_file(spark, sf):
    return stats.links_per_source_file(fx.curated(spark, sf))


@query("G2_source_order", text(L, "SELECT id, source_file, source_order FROM links"))
def source_order(spark, sf):
    return fx.links(spark, sf).select("id", "source_file", "source_order")


@query("H1_page", text(C, f"SELECT id, seq, original_url FROM curated {NEWEST} LIMIT 50 OFFSET 100"))
def page(spark, sf):
    return listing.page(fx.curated(spark, sf), 50, 100).select("id", "seq", "original_url")


@query("H1_page_after", text(C, f"SELECT id, seq FROM curated WHERE seq < 1500 {NEWEST} LIMIT 50"))
def page_after(spark, sf):
    at = F.timestamp_seconds(F.lit(1500 + 1704067200))
    return listing.page_after(fx.curated(spark, sf), at, 1500, 50).select("id", "seq")


@query("H2_sample_duplicates", text(C, f"SELECT id, original_url, domain, status, duplicate_of FROM curated WHERE duplicate_of IS NOT NULL {NEWEST} LIMIT 10"))
def sample_duplicates(spark, sf):
    hits = listing.duplicate_links(fx.curated(spark, sf))
    return listing.sample(hits, ["id", "original_url", "domain", "status", "duplicate_of"])


@query("H5_sorted_by_title", text(C, "SELECT id, title, seq FROM curated"))
def sorted_by_title(spark, sf):
    return listing.sorted_by(fx.curated(spark, sf), "title", descending=True).select("id", "title", "seq")


@query("I1_distinct_urls", text(C, "SELECT DISTINCT original_url FROM curated"))
def distinct_urls(spark, sf):
    return fx.curated(spark, sf).select("original_url").distinct()


@query("B2_export_json", text(C, "SELECT seq, id, original_url, status FROM curated WHERE status = 'imported'"))
def export_json(spark, sf):
    from hrefmill.operators.export import json_lines, select_for_export

    lines = json_lines(select_for_export(fx.curated(spark, sf), status="imported").select("seq", "id", "original_url", "status"))
    back = F.from_json("line", "seq bigint, id string, original_url string, status string")
    return lines.select(back.alias("r")).select("r.*")


@query(
    "B3_export_csv",
    text(C, """SELECT seq, concat('"', id, '","', replace(original_url, '"', '""'), '","', normalized_url, '","', domain, '","', title,
                      '","', source, '","', status, '","', replace(tags, '"', '""'), '","', CASE WHEN is_internal THEN 'true' ELSE 'false' END, '"') AS line FROM curated"""),
)
def export_csv(spark, sf):
    from hrefmill.operators.export import csv_lines

    # The two time stamps end the line; the last one is the time of the run.
    return csv_lines(fx.curated(spark, sf)).select("seq", F.regexp_replace("line", '(,"[^"]*"){2}$', "").alias("line"))


@query(
    "B8_backfill_url_parts",
    text(L, "SELECT id, url_path, url_query, url_hash, (url_path IS NOT NULL AND seq % 4 = 0) OR (url_query IS NOT NULL AND seq % 4 = 0) OR (url_hash IS NOT NULL AND seq % 4 = 0) AS changed FROM links"),
)
def backfill(spark, sf):
    return ingest.backfill_url_parts(_unparsed(fx.links(spark, sf))).select("id", "url_path", "url_query", "url_hash", "changed")


@query("B8_backfill_dry_run", text(L, "SELECT count(*) AS scanned, count(*) FILTER (WHERE ok_part AND seq % 4 = 0) AS would_update, 0::BIGINT AS would_null FROM (SELECT seq, url_path IS NOT NULL AS ok_part FROM links)"))
def backfill_dry_run(spark, sf):
    return ingest.backfill_dry_run(_unparsed(fx.links(spark, sf)))


def _unparsed(links):
    """Links written before the part columns existed: every fourth row lacks them."""
    return links.withColumns({c: F.when(F.col("seq") % 4 != 0, F.col(c)) for c in ("url_path", "url_query", "url_hash")})
