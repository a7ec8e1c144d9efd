"""Transitions, the operation log, pruning and availability results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hrefmill.catalog import fixtures as fx
from hrefmill.catalog.registry import query, text
from hrefmill.operators import audit, prune, results, stats, transitions
from hrefmill.storage import shared_dir

L, C = fx.LINKS_SQL, fx.CURATED_SQL
OPS, CHG, SNAP, RES = fx.OPERATIONS_SQL, fx.CHANGES_SQL, fx.SNAPSHOTS_SQL, fx.RESULTS_SQL
STATE = "md5(id || '|' || status || '|' || tags || '|' || CASE WHEN is_internal THEN 'true' ELSE 'false' END || '|' || coalesce(duplicate_of, 'null') || '|' || coalesce(similarity_group, 'null'))"


def _tree(source: str, name: str) -> str:
    return f"""
{name}_6 AS (SELECT left(md5(id), 6) AS node, sha256(string_agg(id || ':' || {STATE}, '|' ORDER BY id)) AS h FROM {source} GROUP BY 1),
{name}_4 AS (SELECT left(node, 4) AS node, sha256(string_agg(h, '|' ORDER BY node)) AS h FROM {name}_6 GROUP BY 1),
{name}_2 AS (SELECT left(node, 2) AS node, sha256(string_agg(h, '|' ORDER BY node)) AS h FROM {name}_4 GROUP BY 1),
{name}_0 AS (SELECT sha256(string_agg(h, '|' ORDER BY node)) AS h FROM {name}_2)"""


@query("C10_link_state_hash", text(C, f"SELECT id, {STATE} AS state FROM curated"))
def link_state(spark, sf):
    return audit.link_state(fx.curated(spark, sf))


@query("F13_state_hash", text(C, "SELECT h AS state_hash FROM t_0", _tree("curated", "t")))
def state_hash(spark, sf):
    return audit.state_hash(fx.curated(spark, sf))


def _two_states(spark, sf):
    """The links before and after cleaning, with some links only on one side."""
    return fx.links(spark, sf).filter("seq % 10 <> 3"), fx.curated(spark, sf).filter("seq % 10 <> 2")


def _changed(column: str) -> str:
    return f"""SELECT b.id AS link_id, 'modified' AS kind, '{column}' AS field, CAST(b.{column} AS VARCHAR) AS before, CAST(a.{column} AS VARCHAR) AS after
        FROM links b JOIN curated a ON a.id = b.id WHERE b.seq % 10 NOT IN (2, 3) AND b.{column} IS DISTINCT FROM a.{column}"""


DIFF = (
    "changes AS ("
    + " UNION ALL ".join(_changed(c) for c in ["status", "tags", "is_internal", "duplicate_of"])
    + """ UNION ALL SELECT id, 'added', NULL, NULL, NULL FROM curated WHERE seq % 10 = 3
          UNION ALL SELECT id, 'removed', NULL, NULL, NULL FROM links WHERE seq % 10 = 2)"""
)


@query("F12_diff_links", text(C, "SELECT * FROM changes", DIFF))
def diff(spark, sf):
    return audit.diff_links(*_two_states(spark, sf)).drop("op_seq")


@query("F12_diff_summary", text(C, "SELECT count(*) FILTER (WHERE kind = 'added') AS added, count(*) FILTER (WHERE kind = 'removed') AS removed, count(DISTINCT link_id) FILTER (WHERE kind = 'modified') AS modified FROM changes", DIFF))
def diff_counts(spark, sf):
    return audit.diff_summary(audit.diff_links(*_two_states(spark, sf)))


@query("F19_operation_stats", text(C, "SELECT (SELECT count(*) FROM links) AS stats_input_count, count(*) AS stats_output_count, count(*) FILTER (WHERE status = 'duplicate_removed') AS stats_duplicate_count, 0::BIGINT AS stats_error_count FROM curated"))
def op_stats(spark, sf):
    return stats.operation_stats(fx.links(spark, sf), fx.curated(spark, sf))


@query(
    "F19_observed_stats",
    text(C, """SELECT (SELECT count(*) FROM links) AS stats_input_count, count(*) AS stats_output_count,
                      count(*) FILTER (WHERE status = 'duplicate_removed') AS stats_duplicate_count,
                      (SELECT count(*) FROM links WHERE url_path IS NULL) AS stats_error_count FROM curated"""),
)
def observed_stats(spark, sf):
    """Counts taken while the state after a transition is written; malformed links are its errors."""
    links = fx.links(spark, sf)
    path = f"{shared_dir(spark)}/hrefmill/{spark.sparkContext.applicationId}/observed-{uuid.uuid4().hex}"
    return stats.write_observed(links, fx.curated(spark, sf), lambda df: df.write.parquet(path), links.filter("url_path IS NULL"))


@query(
    "J11_log_with_messages",
    text(C, """SELECT 9::BIGINT AS op_seq, (SELECT count(*) FROM links WHERE url_path IS NULL) AS stats_error_count,
                      (SELECT count(*) FROM links WHERE url_path IS NULL) AS errors, (SELECT count(*) FROM links WHERE private) AS warnings,
                      (SELECT string_agg(id, ',' ORDER BY id) FROM links WHERE url_path IS NULL) AS blamed,
                      (SELECT string_agg(DISTINCT id || ' ' || status, ',' ORDER BY id || ' ' || status) FROM curated WHERE status <> 'imported') AS changed"""),
)
def log_with_messages(spark, sf):
    """The row, the messages and the change rows of one operation."""
    links, after = fx.links(spark, sf), fx.curated(spark, sf)
    told = audit.operation_messages(
        9,
        links.filter("url_path IS NULL").select(F.lit("malformed").alias("message"), F.col("id").alias("link_id")),
        links.filter("domain LIKE '10.%'").select(F.lit("private").alias("message")),
    )
    row, changes = audit.log_operation("deduplicate", 9, links, after, messages=told)
    sums = told.agg(
        F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "warning").alias("warnings"),
        F.array_join(F.array_sort(F.collect_list("link_id")), ",").alias("blamed"),
    )
    edits = changes.filter("kind = 'modified' AND field = 'status'")
    edits = edits.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "link_id", F.get_json_object(F.concat(F.lit('{"v":'), F.when(F.col("after").startswith('"'), F.col("after")).otherwise(F.concat(F.lit('"'), "after", F.lit('"'))), F.lit("}")), "$.v")))), ",").alias("changed"))
    return row.select("op_seq", "stats_error_count").crossJoin(sums).crossJoin(edits)


@query(
    "J11_snapshot_after_operation",
    text(C, """SELECT (SELECT count(*) FILTER (WHERE timestamp > (SELECT max(created_at) FROM snapshots)) FROM operations) + 10 >= 10 AS made,
                      (SELECT count(*) FROM curated) AS link_count, (SELECT count(*) FROM curated) AS listed""", OPS, SNAP),
)
def snapshot_after_operation(spark, sf):
    """Ten operations after the last snapshot make another one; with no operation since, none is made."""
    ops, snaps, links = fx.operations(spark, sf), fx.snapshots(spark, sf), fx.curated(spark, sf)
    last = snaps.agg(F.max("created_at").alias("last")).first()["last"]
    assert audit.snapshot_if_due(ops.filter(F.col("timestamp") <= last), snaps, links, "none", F.current_timestamp()) is None
    late = ops.limit(10).withColumn("timestamp", F.lit(last) + F.expr("INTERVAL 1 DAY"))
    made = audit.snapshot_if_due(ops.unionByName(late), snaps, links, "s9", F.current_timestamp())
    row, listed = made
    return row.crossJoin(listed.agg(F.count_distinct("link_id").alias("listed"))).select(F.lit(True).alias("made"), "link_count", "listed")


@query(
    "C16_message_decode",
    f"""SELECT event_id AS op_seq, 'error' AS kind, 'no answer ' || CAST(user_id AS VARCHAR) AS message, {fx._LINKED} AS link_id FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_id, 'warning', 'twice', NULL FROM events WHERE event_type = 'click'
        UNION ALL SELECT event_id, 'warning', 'slow ' || CAST(user_id AS VARCHAR), {fx._LINKED} FROM events WHERE event_type = 'click'""",
)
def decode_messages(spark, sf):
    return audit.decode_messages(fx.stored_operations(spark, sf))


@query(
    "J11_log_operation",
    text(C, """SELECT 7::BIGINT AS op_seq, 'deduplicate' AS type, (SELECT h FROM b_0) AS before_hash, (SELECT h FROM a_0) AS after_hash,
                      (SELECT count(*) FROM links) AS stats_input_count, (SELECT count(*) FROM curated) AS stats_output_count""", _tree("links", "b"), _tree("curated", "a")),
)
def log_operation(spark, sf):
    row, _ = audit.log_operation("deduplicate", 7, fx.links(spark, sf), fx.curated(spark, sf))
    return row.select("op_seq", "type", "before_hash", "after_hash", "stats_input_count", "stats_output_count")


@query("J1_bulk_update", text(C, "SELECT id, CASE WHEN seq % 3 = 0 THEN 'n' || CAST(seq AS VARCHAR) ELSE title END AS title, CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'pending' ELSE status END AS status FROM curated"))
def bulk_update(spark, sf):
    links = fx.curated(spark, sf)
    updates = links.filter("seq % 3 = 0").select(
        "id", F.concat(F.lit("n"), "seq").alias("title"), F.when(F.col("seq") % 2 == 0, "pending").alias("status")
    )
    return transitions.bulk_update(links, updates).select("id", "title", "status")


@query("J3_filter_internal_execute", text(L, "SELECT id, CASE WHEN private THEN 'filtered_internal' ELSE status END AS status, private AS is_internal FROM links"))
def filter_internal(spark, sf):
    return transitions.filter_internal_execute(fx.links(spark, sf)).select("id", "status", "is_internal")


@query("J5_manual_update", text(C, "SELECT id, CASE WHEN seq % 9 = 0 THEN 'renamed' ELSE title END AS title FROM curated"))
def manual(spark, sf):
    links = fx.curated(spark, sf)
    return transitions.manual_update(links, links.filter("seq % 9 = 0"), title=F.lit("renamed")).select("id", "title")


@query("C12_add_tag", text(C, """SELECT id, CASE WHEN seq % 4 = 0 AND seq % 6 = 0 THEN '["saved"]' WHEN seq % 4 = 0 THEN '["saved"]' WHEN seq % 6 = 0 THEN '["saved"]' ELSE '[]' END AS tags FROM curated"""))
def add_tag(spark, sf):
    links = fx.curated(spark, sf)
    return transitions.add_tag(links, links.filter("seq % 4 = 0"), " saved ").select("id", F.to_json("tags").alias("tags"))


@query("J6_delete_by_ids", text(C, "SELECT id FROM curated WHERE seq % 5 <> 0"))
def delete(spark, sf):
    links = fx.curated(spark, sf)
    return transitions.delete_links(links, links.filter("seq % 5 = 0")).select("id")


@query("B1_append_links", text(C, "SELECT id, status FROM curated WHERE seq % 2 = 0 UNION ALL SELECT id, status FROM links WHERE seq % 2 = 1"))
def append(spark, sf):
    old, fresh = fx.curated(spark, sf).filter("seq % 2 = 0"), fx.links(spark, sf).filter("seq % 2 = 1")
    return transitions.append_links(old, fresh).select("id", "status")


# --- log ---

@query("D14_operations_after", text(OPS, "SELECT op_seq, id, type FROM operations WHERE op_seq > 100"))
def after(spark, sf):
    return audit.operations_after(fx.operations(spark, sf), 100).select("op_seq", "id", "type")


@query("D14_operations_since", text(OPS, "SELECT op_seq FROM operations WHERE timestamp > TIMESTAMP '2024-01-02 00:00:00'"))
def since(spark, sf):
    return audit.operations_since(fx.operations(spark, sf), F.lit("2024-01-02 00:00:00").cast("timestamp")).select("op_seq")


@query("H3_recent_operations", text(OPS, "SELECT op_seq, type FROM operations ORDER BY timestamp DESC, op_seq DESC LIMIT 50 OFFSET 5"))
def recent(spark, sf):
    return audit.recent_operations(fx.operations(spark, sf), 50, 5).select("op_seq", "type")


@query("H8_latest_snapshot", text(SNAP, "SELECT id FROM snapshots ORDER BY created_at DESC, id DESC LIMIT 1"))
def latest(spark, sf):
    return audit.latest_snapshot(fx.snapshots(spark, sf)).select("id")


@query("J14_delete_operations", text(OPS, "SELECT op_seq FROM operations WHERE type <> 'import'"))
def delete_operations(spark, sf):
    ops = fx.operations(spark, sf)
    return audit.delete_operations(ops, ops.filter("type = 'import'")).select("op_seq")


@query("C15_snapshot_link_count", text(SNAP, "SELECT id, CAST(link_count AS BIGINT) AS link_count FROM snapshots"))
def snapshot_counts(spark, sf):
    return audit.snapshot_link_counts(fx.snapshots(spark, sf)).select("id", "link_count")


@query(
    "C16_operation_payload_decode",
    f"""SELECT event_id AS op_seq, {fx._LINKED} AS link_id,
               CASE event_type WHEN 'signup' THEN 'added' WHEN 'purchase' THEN 'removed' ELSE 'modified' END AS kind,
               CASE WHEN event_type NOT IN ('signup', 'purchase') THEN 'status' END AS field,
               CASE WHEN event_type NOT IN ('signup', 'purchase') THEN 'imported' END AS before,
               CASE WHEN event_type NOT IN ('signup', 'purchase') THEN event_type END AS after FROM events""",
)
def decode(spark, sf):
    return audit.decode_operations(fx.stored_operations(spark, sf))


@query("J12_snapshot_due", text(OPS, "SELECT count(*) FILTER (WHERE timestamp > (SELECT max(created_at) FROM snapshots)) AS operations_since, count(*) FILTER (WHERE timestamp > (SELECT max(created_at) FROM snapshots)) >= 10 AS due FROM operations", SNAP))
def due(spark, sf):
    return audit.snapshot_due(fx.operations(spark, sf), fx.snapshots(spark, sf)).select("operations_since", "due")


@query("J12_create_snapshot", text(C, "SELECT 's1' AS id, (SELECT count(*) FROM curated) AS link_count, h AS checksum FROM t_0", _tree("curated", "t")))
def create_snapshot(spark, sf):
    row, _ = audit.create_snapshot(fx.curated(spark, sf), "s1", F.current_timestamp())
    return row.select("id", "link_count", "checksum")


def _asof(join: str) -> str:
    return text(OPS, f"SELECT o.op_seq, s.id AS snapshot_id FROM operations o ASOF LEFT JOIN snapshots s ON {join}", SNAP)


@query("E4_snapshot_before", _asof("o.timestamp >= s.created_at"))
def snapshot_before(spark, sf):
    return audit.snapshot_for_operations(fx.operations(spark, sf), fx.snapshots(spark, sf), "before")


@query("E4_snapshot_after", _asof("o.timestamp < s.created_at"))
def snapshot_after(spark, sf):
    return audit.snapshot_for_operations(fx.operations(spark, sf), fx.snapshots(spark, sf), "after")


@query("E4_newest_snapshot", text(OPS, "SELECT op_seq, CASE WHEN timestamp < (SELECT max(created_at) FROM snapshots) THEN (SELECT id FROM snapshots ORDER BY created_at DESC, id DESC LIMIT 1) END AS snapshot_id FROM operations", SNAP))
def newest_snapshot(spark, sf):
    return audit.snapshot_for_operations(fx.operations(spark, sf), fx.snapshots(spark, sf))


@query(
    "J13_rollback",
    text(C, """SELECT c.id, coalesce((SELECT arg_min(before, op_seq) FROM changes x WHERE x.op_seq > 500 AND x.kind = 'modified' AND x.field = 'status' AND x.link_id = c.id), c.status) AS status,
                      coalesce((SELECT arg_min(before, op_seq) FROM changes x WHERE x.op_seq > 500 AND x.kind = 'modified' AND x.field = 'title' AND x.link_id = c.id), c.title) AS title
               FROM curated c WHERE id NOT IN (SELECT link_id FROM changes WHERE op_seq > 500 AND kind = 'added')""", CHG),
)
def rollback(spark, sf):
    back = audit.rollback(fx.curated(spark, sf), fx.changes(spark, sf), 500)
    return back.select("id", "status", "title")


# --- prune ---

# The two domains with most links.
TOP = "(SELECT domain FROM curated WHERE domain <> '' GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 2)"


def top_domains(spark, sf):
    named = fx.curated(spark, sf).filter("domain <> ''").groupBy("domain").count()
    return named.orderBy(F.desc("count"), "domain").limit(2).select("domain")


KINDS = {
    "duplicate": ("duplicate_of IS NOT NULL", None),
    "internal": ("is_internal", None),
    "by-domain": (f"domain IN {TOP}", top_domains),
    "all": ("TRUE", None),
}


def _register_kind(kind, condition, domains):
    label = kind.replace("-", "_")
    doomed = f"(SELECT id FROM curated WHERE {condition})"

    @query(
        f"J7_prune_report_{label}",
        text(C, f"SELECT '{kind}' AS kind, (SELECT count(*) FROM curated WHERE {condition}) AS links, count(*) AS test_results FROM results WHERE link_id IN {doomed}", RES),
    )
    def report(spark, sf):
        return prune.prune_report(fx.curated(spark, sf), fx.test_results(spark, sf), kind, domains and domains(spark, sf))

    # Counts before and after as well, so that pruning all reads the table.
    @query(
        f"J7_prune_links_{label}",
        text(C, f"""SELECT id, 0::BIGINT AS n FROM curated WHERE NOT ({condition})
                    UNION ALL SELECT 'before', count(*) FROM curated
                    UNION ALL SELECT 'after', count(*) FROM curated WHERE NOT ({condition})"""),
    )
    def links_left(spark, sf):
        before = fx.curated(spark, sf)
        after = prune.prune_links(before, kind, domains and domains(spark, sf))
        rows = after.select("id", F.lit(0).cast("bigint").alias("n"))
        for name, df in (("before", before), ("after", after)):
            rows = rows.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("id"), "n"))
        return rows

    @query(f"H2_prune_sample_{label}", text(C, f"SELECT id, original_url, domain, status FROM curated WHERE {condition} ORDER BY seq DESC LIMIT 10"))
    def sample(spark, sf):
        return prune.prune_sample(fx.curated(spark, sf), kind, domains and domains(spark, sf)).select("id", "original_url", "domain", "status")


for _kind, (_condition, _domains) in KINDS.items():
    _register_kind(_kind, _condition, _domains)

_CASCADE = {
    "E1_cascade_count_duplicates": "duplicate",
    "E2_cascade_count_internal": "internal",
    "E3_cascade_count_domains": "by-domain",
}


def _register_cascade(name, kind):
    condition, domains = KINDS[kind]

    @query(name, text(C, f"SELECT count(*) AS test_results FROM results JOIN curated ON link_id = curated.id WHERE {condition}", RES))
    def run(spark, sf):
        doomed = prune.doomed_links(fx.curated(spark, sf), kind, domains and domains(spark, sf))
        return prune.cascade_count(fx.test_results(spark, sf), doomed)


for _name, _kind in _CASCADE.items():
    _register_cascade(_name, _kind)


@query("E2_cascade_count_internal_results", text(C, "SELECT count(*) AS test_results FROM results JOIN curated ON link_id = curated.id WHERE " + KINDS["internal"][0], fx.PRIVATE_RESULTS_SQL))
def cascade_internal(spark, sf):
    """Here links on private hosts do have results."""
    doomed = prune.doomed_links(fx.curated(spark, sf), "internal", None)
    return prune.cascade_count(fx.results_of_private_links(spark, sf), doomed)


@query("E11_cascade_results", text(C, "SELECT id, link_id FROM results WHERE link_id NOT IN (SELECT id FROM curated WHERE duplicate_of IS NOT NULL)", RES))
def cascade_results(spark, sf):
    doomed = fx.curated(spark, sf).filter(prune.selection("duplicate"))
    return prune.cascade_results(fx.test_results(spark, sf), doomed).select("id", "link_id")


@query("E11_detach_jobs", text(OPS, "SELECT op_seq, CASE WHEN job_id NOT IN ('job1', 'job2', 'job3') THEN job_id END AS job_id FROM operations"))
def detach(spark, sf):
    ops = fx.operations(spark, sf)
    gone = ops.filter(F.col("job_id").isin("job1", "job2", "job3")).select(F.col("job_id").alias("id")).distinct()
    return prune.detach_jobs(ops, gone).select("op_seq", "job_id")


@query("J8_database_report", text(C, "SELECT (SELECT count(*) FROM curated) AS links, (SELECT count(DISTINCT job_id) FROM operations) AS jobs, (SELECT count(*) FROM results) AS test_results", RES, OPS))
def database_report(spark, sf):
    jobs = fx.operations(spark, sf).filter("job_id IS NOT NULL").select("job_id").distinct()
    return prune.database_report(fx.curated(spark, sf), jobs, fx.test_results(spark, sf))


@query("J8_prune_database", text(OPS, "SELECT op_seq, CAST(NULL AS VARCHAR) AS job_id FROM operations"))
def prune_database(spark, sf):
    ops = fx.operations(spark, sf)
    after = prune.prune_database(fx.curated(spark, sf), ops, fx.test_results(spark, sf), ops)
    return after["operations"].select("op_seq", "job_id")


@query(
    "J8_prune_database_tables",
    text(C, """SELECT 'links' AS name, count(*) AS before, 0::BIGINT AS after, 0::BIGINT AS with_job FROM curated
               UNION ALL SELECT 'import_jobs', count(*), 0, 0 FROM sources UNION ALL SELECT 'test_results', count(*), 0, 0 FROM results
               UNION ALL SELECT 'operations', count(*), count(*), 0 FROM operations""", RES, OPS, fx.SOURCES_SQL.removeprefix(fx.PAGES_SQL + ",")),
)
def prune_database_tables(spark, sf):
    """All four tables before and after; the log stays, without its jobs."""
    before = {"links": fx.curated(spark, sf), "import_jobs": fx.source_jobs(spark, sf), "test_results": fx.test_results(spark, sf), "operations": fx.operations(spark, sf)}
    after = prune.prune_database(before["links"], before["import_jobs"], before["test_results"], before["operations"])
    one = stats.table_counts(before).withColumnRenamed("total", "before")
    two = stats.table_counts(after).withColumnRenamed("total", "after")
    jobs = after["operations"].agg(F.count("job_id").alias("n")).select(F.lit("operations").alias("name"), "n")
    return one.join(two, "name").join(jobs, "name", "left").select("name", "before", "after", F.coalesce("n", F.lit(0)).cast("bigint").alias("with_job"))


@query("J9_audit_report", text(OPS, "SELECT (SELECT count(*) FROM operations) AS operations, (SELECT count(*) FROM snapshots) AS snapshots", SNAP))
def audit_report(spark, sf):
    return prune.audit_report(fx.operations(spark, sf), fx.snapshots(spark, sf))


@query(
    "J9_prune_audit",
    text(OPS, """SELECT 'operations' AS name, count(*) AS before, 0::BIGINT AS after FROM operations
                 UNION ALL SELECT 'snapshots', count(*), 0 FROM snapshots""", SNAP),
)
def prune_audit(spark, sf):
    """Rows of both tables before and after."""
    before = {"operations": fx.operations(spark, sf), "snapshots": fx.snapshots(spark, sf)}
    after = prune.prune_audit(before["operations"], before["snapshots"])
    rows = None
    for name, df in before.items():
        counted = df.agg(F.count(F.lit(1)).alias("before")).crossJoin(after[name].agg(F.count(F.lit(1)).alias("after")))
        counted = counted.select(F.lit(name).alias("name"), "before", "after")
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


# --- results ---

@query("M1_results_of_link", text(RES, "SELECT id, method, status FROM results WHERE link_id = md5('70')"))
def of_link(spark, sf):
    return results.results_of_link(fx.test_results(spark, sf), _md5("70")).select("id", "method", "status")


def _md5(value: str) -> str:
    import hashlib

    return hashlib.md5(value.encode()).hexdigest()


@query("M1_results_of_links", text(C, "SELECT id, link_id FROM results WHERE link_id IN (SELECT id FROM curated WHERE is_internal OR duplicate_of IS NOT NULL)", RES))
def of_links(spark, sf):
    ids = fx.curated(spark, sf).filter("is_internal OR duplicate_of IS NOT NULL").select("id")
    return results.results_of_links(fx.test_results(spark, sf), ids).select("id", "link_id")


@query("M2_method_progress", text(RES, "SELECT method, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM results GROUP BY method"))
def progress(spark, sf):
    return results.method_progress(fx.test_results(spark, sf))


@query(
    "M3_fold_results",
    text(C, """SELECT c.id, coalesce(CASE WHEN r.id IS NULL THEN NULL WHEN r.status = 'success' THEN 'success' WHEN r.error LIKE '%timeout%' THEN 'timeout'
                      WHEN r.error LIKE '%refused%' THEN 'connection_refused' WHEN r.method = 'dns' THEN 'dns_failed' ELSE 'error' END, c.status) AS status
               FROM curated c LEFT JOIN newest r ON r.link_id = c.id""", RES,
         "newest AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY completed_at DESC, id DESC) = 1)"),
)
def fold(spark, sf):
    return results.fold_results(fx.curated(spark, sf), fx.test_results(spark, sf)).select("id", "status")
