"""Search, log, rollback, pruning, results, imports, tables and streams."""

import hashlib

import pytest
from helpers import make_links
from pyspark.sql import functions as F

from hrefmill.operators import audit, dedup, export, ingest, listing, prune, results, search, transitions
from hrefmill.sources import files, tables
from hrefmill.streaming import folders, streams


@pytest.mark.parametrize(
    "query, expected",
    [
        ("", ({}, [])), ("   ", ({}, [])), ("foo bar baz", ({}, ["foo", "bar", "baz"])),
        ("host:foo path:bar", ({"host": ["foo"], "path": ["bar"]}, [])), ("host:foo bar", ({"host": ["foo"]}, ["bar"])),
        ("host:a host:b", ({"host": ["a", "b"]}, [])), ("foo:bar", ({}, ["foo:bar"])), ("host:", ({}, ["host:"])),
        ("HOST:foo", ({"host": ["foo"]}, [])), ("foo   bar", ({}, ["foo", "bar"])),
        ("host:a path:b search:c", ({"host": ["a"], "path": ["b"], "search": ["c"]}, [])),
    ],
)
def test_search_terms(query, expected):
    assert search.split_terms(query) == expected


def test_search_modes(spark):
    links = make_links(spark, ["https://www.foo.com/bar?q=baz#top", "https://bar.com/foo", "not foo url", "https://x.com/"])
    links = transitions.change(links, F.col("id") == "L3", {"title": F.lit("Foo Title"), "tags": F.array(F.lit("bar"))})
    ids = lambda *a, **k: {r["id"] for r in search.search_links(links, *a, **k).collect()}
    assert ids("foo") == {"L0", "L1", "L2", "L3"}
    assert ids("foo title") == {"L3"} and ids('"bar"') == {"L3"}
    assert ids("host:foo") == {"L0", "L2"}
    assert ids("host:foo path:bar") == {"L0"} and ids("host:foo host:bar") == {"L0", "L1", "L2"}
    assert ids("foo", parts=["path"]) == {"L1", "L2"}
    assert ids("foo", parts=[]) == ids("foo", parts=["host", "path", "search", "hash"]) == ids("foo")
    assert ids("hash:top search:baz") == {"L0"}
    assert ids("") == {"L0", "L1", "L2", "L3"} and ids("  ", parts=["host"]) == {"L0", "L1", "L2", "L3"}
    assert ids("f_o", literal=True) == set()
    assert search.search_count(links, "foo", status="imported").first()["total"] == 4


def test_pages_follow_each_other(spark):
    links = make_links(spark, [f"https://a.com/{i}" for i in range(25)])
    first = listing.page(links, 10).collect()
    last = first[-1]
    after = listing.page_after(links, F.lit(last["created_at"]), last["seq"], 10).collect()
    assert [r["seq"] for r in first + after] == list(range(24, 4, -1))
    assert [r["seq"] for r in listing.page(links, 10, 10).collect()] == [r["seq"] for r in after]
    with pytest.raises(ValueError):
        listing.page(links, 201)
    assert [r["id"] for r in listing.pick(links, "id", ["x"] * 1001 + ["L3"]).collect()] == ["L3"]


def test_state_hashes(spark):
    links = make_links(spark, [f"https://a.com/{i}" for i in range(30)])
    tree = audit.state_hash(links).first()[0]
    assert tree == audit.state_hash(links.repartition(5)).first()[0]
    assert tree != audit.state_hash(transitions.set_status(links, links.limit(1), "error")).first()[0]


def test_rollback_undoes_what_the_log_says(spark):
    start = make_links(spark, ["https://a.com/1", "https://a.com/1/", "http://10.0.0.1/", "https://b.com/"])
    steps = [
        ("deduplicate", dedup.dedup_execute),
        ("filter_internal", transitions.filter_internal_execute),
        ("manual_tag", lambda x: transitions.add_tag(x, x.filter("id = 'L3'"), " t ")),
        ("manual_tag", lambda x: transitions.manual_update(x, x.filter("id = 'L3'"), title=F.lit("new"), status=F.lit("error"))),
        ("import", lambda x: transitions.append_links(x, make_links(spark, ["https://c.com/"]).withColumn("id", F.lit("N")))),
    ]
    states, ops, changes = [start], None, None
    for k, (kind, step) in enumerate(steps):
        after = step(states[-1])
        op, change = audit.log_operation(kind, k, states[-1], after)
        ops = op if ops is None else ops.unionByName(op)
        changes = change if changes is None else changes.unionByName(change)
        states.append(after)
    ops, changes = spark.createDataFrame(ops.collect(), ops.schema), spark.createDataFrame(changes.collect(), changes.schema)
    shape = lambda df: sorted(tuple(r) for r in df.withColumn("tags", F.to_json("tags")).drop("updated_at").select("id", "status", "title", "tags", "is_internal", F.coalesce("duplicate_of", F.lit(""))).collect())
    for target in range(4):
        back, left, kept = audit.rollback_to(states[-1], ops, changes, target)
        assert shape(back) == shape(states[target + 1])
        assert left.count() == target + 1 and kept.filter(F.col("op_seq") > target).count() == 0
    assert [r["stats_duplicate_count"] for r in ops.orderBy("op_seq").collect()][0] == 1
    with pytest.raises(ValueError):
        audit.rollback_to(states[-1], ops, changes, 4)
    with pytest.raises(ValueError):
        audit.rollback_to(states[-1], ops, changes, 99)


def test_snapshots_and_asof(spark):
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    ops = spark.createDataFrame([(i, f"o{i}", i * 10) for i in range(1, 13)], "op_seq long, id string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    snaps = spark.createDataFrame([("a", 20), ("b", 45)], "id string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    find = lambda d: {r["op_seq"]: r["snapshot_id"] for r in audit.snapshot_for_operations(ops, snaps, d).collect()}
    before, after, newest = find("before"), find("after"), find("newest_after")
    assert (before[1], before[2], before[4], before[5]) == (None, "a", "a", "b")
    assert (after[1], after[2], after[4], after[5]) == ("a", "b", "b", None)
    assert (newest[1], newest[4], newest[5]) == ("b", "b", None)
    assert audit.snapshot_due(ops, snaps).first()["due"] is False
    assert audit.snapshot_due(ops, snaps.filter("id = 'a'")).first()["due"] is True
    assert audit.snapshot_due(ops, snaps.limit(0)).first()["due"] is True
    links = make_links(spark, ["https://a.com/"])
    row, ids = audit.create_snapshot(links, "s", ts(5))
    assert row.first()["link_count"] == 1 and ids.first()["link_id"] == "L0"


def test_prune_and_cascades(spark):
    links = dedup.dedup_execute(make_links(spark, ["https://a.com/1", "https://a.com/1/", "https://b.com/"]))
    rows = [(1, "L1", "get", "failed", "Timeout", 5), (2, "L1", "get", "success", None, 9), (3, "L2", "dns", "failed", None, 9), (4, "L0", "head", "failed", "refused", 9)]
    res = spark.createDataFrame(rows, "id long, link_id string, method string, status string, error string, completed_at long")
    assert prune.prune_report(links, res, "duplicate").first().asDict() == {"kind": "duplicate", "links": 1, "test_results": 2}
    assert prune.prune_report(links, res, "by-domain", []).first()["links"] == 0
    assert prune.prune_links(links, "by-domain", ["a.com"]).count() == 1
    assert prune.prune_links(links, "by-domain", [f"{i}.com" for i in range(1500)] + ["a.com"]).count() == 1
    nameless = links.withColumn("domain", F.lit(None).cast("string"))
    assert prune.prune_links(nameless, "by-domain", ["a.com"]).count() == links.count()
    assert sorted(r["id"] for r in prune.cascade_results(res, links.filter("id = 'L1'")).collect()) == [3, 4]
    assert prune.prune_sample(links, "duplicate").first()["duplicate_of"] == "L0"
    folded = {r["id"]: r["status"] for r in results.fold_results(links, res).collect()}
    assert folded == {"L0": "connection_refused", "L1": "success", "L2": "dns_failed"}
    with pytest.raises(ValueError):
        prune.selection("everything")


def test_reparse_adds_only_new_urls(spark):
    stored = make_links(spark, ["https://example.com/a", "https://example.com/c"])
    fresh = make_links(spark, [f"https://example.com/{x}" for x in "abcdd"])
    assert [r["original_url"][-1] for r in ingest.only_new(fresh, stored).orderBy("seq").collect()] == ["b", "d", "d"]
    other = stored.withColumn("source_file", F.lit("other.txt"))
    assert ingest.only_new(fresh, other).count() == 5
    assert [r["source_order"] for r in ingest.renumbered(ingest.only_new(fresh, stored)).orderBy("seq").collect()] == [0, 1, 2]


def test_link_rows_take_parts_from_the_original_url(spark):
    row = make_links(spark, ["https://www.example.com/path/?q=1#section", "not-a-url"]).orderBy("seq").collect()
    assert (row[0]["normalized_url"], row[0]["domain"]) == ("https://example.com/path?q=1", "www.example.com")
    assert (row[0]["url_path"], row[0]["url_query"], row[0]["url_hash"]) == ("/path/", "q=1", "section")
    assert (row[1]["normalized_url"], row[1]["domain"], row[1]["url_path"]) == ("not-a-url", "", None)
    df = spark.createDataFrame([(0, "https://a.com"), (1, "not-a-url"), (2, " "), (3, "://")], "pos long, url string")
    valid, invalid = ingest.partition_valid(df)
    assert [r["pos"] for r in valid.orderBy("pos").collect()] == [0, 2]
    assert [r["url"] for r in invalid.orderBy("pos").collect()] == ["not-a-url", "://"]


def test_job_lifecycle(spark):
    lines = files.lines_of(spark.createDataFrame([("a.txt", "https://a.com\nhttps://a b.com\nhttps://b.com"), ("b.txt", "https://c.com")], "filename string, content string"))
    found = spark.createDataFrame([("a.txt", "TXT", 5), ("b.txt", "TXT", 6)], "filename string, type string, s long").withColumn("modified_at", F.timestamp_seconds("s"))
    empty = ingest.register_sources(found, found.select("filename"))
    jobs = ingest.register_sources(found, empty)
    assert jobs.count() == 2 and ingest.register_sources(found, jobs).count() == 0
    parsed = ingest.parse_sources(lines, jobs)
    rows = ingest.new_links(parsed, first_seq=100).orderBy("seq").collect()
    assert [(r["seq"], r["source_file"], r["source_order"]) for r in rows] == [(100, "a.txt", 0), (101, "a.txt", 1), (102, "b.txt", 0)]
    done = ingest.finish_jobs(jobs, ingest.job_counts(parsed), found, F.current_timestamp())
    assert {r["filename"]: (r["status"], r["imported_count"], r["error_count"]) for r in done.collect()} == {"a.txt": ("completed", 2, 1), "b.txt": ("completed", 1, 0)}
    assert ingest.stale_sources(found, done).count() == 0
    assert ingest.stale_sources(found.withColumn("modified_at", F.timestamp_seconds(F.lit(9))), done).count() == 2
    assert ingest.stale_sources(found, done.withColumn("file_mtime", F.lit(None).cast("timestamp"))).count() == 2
    long = jobs.withColumn("filename", F.repeat(F.lit("x"), 120))
    assert len(ingest.list_jobs(long).first()["filename"]) == 101


def test_exports_on_disk(spark, tmp_path):
    links = make_links(spark, ["https://a.com/1", 'https://b.com/"q"'])
    export.write_links_csv(links, str(tmp_path / "csv"))
    text = sorted(r[0] for r in spark.read.text(str(tmp_path / "csv")).collect())
    assert any(t.startswith('"L0","https://a.com/1"') and t.count('","') == 10 for t in text)
    export.write_links_json(links, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    lines = files.lines_of(spark.createDataFrame([("d/x.txt", "https://a.com\nhttps://b.com")], "filename string, content string"))
    found = export.export_sources(lines)
    digest = hashlib.sha256(b"https://a.com\nhttps://b.com").hexdigest()[:8]
    assert {r["export_name"] for r in found.collect()} == {f"x-{digest}.json"}
    export.write_exports(found, str(tmp_path / "out"), rows_per_part=1)
    assert [r["url"] for r in spark.read.json(str(tmp_path / "out")).orderBy("part").collect()] == ["https://a.com", "https://b.com"]
    assert export.export_sources(lines, existing=found.select("export_name")).count() == 0


def test_backfill_is_idempotent(spark):
    links = make_links(spark, ["https://a.com/1?x#y", "bad url"])
    old = links.withColumns({"url_path": F.lit(None).cast("string"), "url_hash": F.lit("stale")})
    report = ingest.backfill_dry_run(old).first()
    assert (report["scanned"], report["would_update"], report["would_null"]) == (2, 1, 1)
    assert ingest.backfill_dry_run(ingest.backfill_url_parts(old).drop("changed")).first()["would_update"] == 0


def test_versioned_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(3), spark.range(5)
    assert tables.publish(spark, root, {"links": one, "jobs": one}) == 1
    assert tables.publish(spark, root, {"links": two}) == 2
    assert tables.read_table(spark, root, "links").count() == 5
    assert tables.read_table(spark, root, "jobs").count() == 3
    assert tables.read_table(spark, root, "links", as_of=1).count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, root, "nothing")


def test_import_stream_resumes_and_equals_batch(spark, tmp_path):
    landing, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "ck"))
    (tmp_path / "in").mkdir()
    jobs = spark.createDataFrame([(i, f"f{i}.txt", "TXT", "normalized") for i in range(4)], "job_seq long, filename string, type string, strategy string")
    for wave in ((0, 1), (2, 3)):
        for i in wave:
            (tmp_path / "in" / f"f{i}.txt").write_text(f"https://a.com/{i}\nhttps://b.com/{i}/\nhttp://bad host/")
        streams.import_stream(streams.stream_source_files(spark, landing, 1), jobs, table, checkpoint).awaitTermination()
    got = streams.read_batches(spark, table)
    batch = ingest.new_links(ingest.parse_sources(files.read_source_lines(spark, landing), jobs), first_seq=0)
    pick = lambda df: sorted(tuple(r) for r in df.select("source_file", "source_order", "original_url", "normalized_url").collect())
    assert pick(got) == pick(batch) and got.count() == 8
    assert got.select("seq").distinct().count() == 8


def test_dedup_stream_keeps_first_arrival(spark, tmp_path):
    source, table = str(tmp_path / "links"), str(tmp_path / "table")
    for wave in range(2):
        part = make_links(spark, [f"https://a.com/{i % 5}" for i in range(10 + wave)]).withColumn("seq", F.col("seq") + 100 * wave)
        part.coalesce(1).write.mode("append").parquet(source)
        streams.dedup_stream(streams.stream_table(spark, source), "normalized_url", table, str(tmp_path / "ck")).awaitTermination()
    kept = streams.read_batches(spark, table).collect()
    assert sorted(r["seq"] for r in kept) == [0, 1, 2, 3, 4]


def test_first_arrivals_carry_every_column(spark, tmp_path):
    source, table = str(tmp_path / "links"), str(tmp_path / "table")
    links = make_links(spark, ["https://a.com/1", "https://b.com/", "https://a.com/1"]).withColumns(
        {"tags": F.array(F.lit('q"é'), F.lit(None)), "updated_at": F.col("created_at") + F.expr("INTERVAL 1 MICROSECOND")}
    )
    nameless = links.filter("seq = 1").withColumns({"seq": F.lit(7).cast("bigint"), "normalized_url": F.lit(None).cast("string")})
    links = links.unionByName(nameless).unionByName(nameless.withColumn("seq", F.lit(8).cast("bigint")))
    links.coalesce(1).write.parquet(source)
    streams.dedup_stream(streams.stream_table(spark, source), "normalized_url", table, str(tmp_path / "ck")).awaitTermination()
    got = streams.read_batches(spark, table).drop("batch")
    want = links.filter("seq IN (0, 1, 7)")
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_state_and_not_the_table_answers(spark, tmp_path):
    """Stored rows are gone, yet repeats of their keys are known."""
    source, table = str(tmp_path / "links"), str(tmp_path / "table")
    for wave in range(2):
        make_links(spark, ["https://a.com/1", f"https://b.com/{wave}"]).coalesce(1).write.mode("append").parquet(source)
        streams.dedup_stream(streams.stream_table(spark, source), "normalized_url", table, str(tmp_path / "ck")).awaitTermination()
        if wave == 0:
            (tmp_path / "table" / "batch=0").rename(tmp_path / "gone")
    assert [r["normalized_url"] for r in streams.read_batches(spark, table).collect()] == ["https://b.com/1"]


def test_fifty_batches_leave_few_folders(spark, tmp_path):
    table = str(tmp_path / "table")
    for n in range(50):
        rows = spark.range(3).withColumn("v", F.lit(n))
        folders.write_batch(rows.coalesce(1), table, n)
        folders.merge_folders(spark, table, n, fanout=4)
        if n == 30:  # the batch runs again, and so does its merge
            folders.write_batch(rows.coalesce(1), table, n)
            folders.merge_folders(spark, table, n, fanout=4)
        got = folders.read_batches(spark, table)
        if n % 7 == 0:
            assert sorted((r["batch"], r["v"], r["id"]) for r in got.collect()) == [(b, b, i) for b in range(n + 1) for i in range(3)]
    ranges, single = folders.folders(spark, table)
    assert len(ranges) + len(single) <= 12 and len(list((tmp_path / "table").glob("*=*"))) <= 24
    assert sorted(r["v"] for r in folders.read_batches(spark, table, before=20).collect()) == sorted(list(range(20)) * 3)
    # A merge that stopped before its list was written changes nothing.
    (tmp_path / "table" / "merged=0-99").mkdir()
    assert folders.read_batches(spark, table).count() == 150


def test_merged_batches_fold_to_the_newest(spark, tmp_path):
    table = str(tmp_path / "table")
    for n in range(10):
        folders.write_batch(spark.createDataFrame([("f", n), (f"g{n}", n)], "filename string, c long").coalesce(1), table, n)
        folders.merge_folders(spark, table, n, fold=lambda rows: streams.newest_per_key(rows, "filename"), fanout=3)
    got = streams.read_batches(spark, table)
    assert got.count() < 20
    assert {(r["filename"], r["c"]) for r in streams.latest_per_key(got, "filename").collect()} == {("f", 9)} | {(f"g{n}", n) for n in range(10)}


def test_stored_keys_read_only_the_buckets_of_a_batch(spark, tmp_path):
    keys = str(tmp_path / "keys")
    for n in range(12):
        rows = spark.createDataFrame([(f"f{i}.txt", f"https://a.com/{n}/{i}") for i in range(40)], "source_file string, normalized_url string")
        streams.write_keys(rows, keys, n)
    asked = spark.createDataFrame([("f3.txt",), ("f4.txt",), ("new.txt",)], "source_file string")
    found = streams.stored_keys(spark, keys, asked, before=11)
    assert sorted(map(tuple, found.collect())) == sorted((f"f{i}.txt", f"https://a.com/{n}/{i}") for n in range(11) for i in (3, 4))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(source_file" in plan
    assert streams.stored_keys(spark, str(tmp_path / "none"), asked, before=3) is None


def test_bounded_dedup_stream(spark, tmp_path):
    source = str(tmp_path / "links")
    make_links(spark, ["https://a.com/1"] * 4 + ["https://b.com/"]).write.parquet(source)
    recent = streams.dedup_recent(streams.stream_table(spark, source), "normalized_url", "created_at", "1 hour")
    out = str(tmp_path / "out")
    recent.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 2
