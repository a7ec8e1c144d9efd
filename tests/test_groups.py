"""Duplicates, similarity and the plans that keep hot keys apart."""

import random
import re

import pandas as pd
import pytest
from helpers import make_links
from pyspark.sql import functions as F

from hrefmill.operators import dedup, similarity, transitions
from hrefmill.operators.similarity import Layer
from hrefmill.plans import leaders, ordering, skew
from hrefmill.plans.leaders import claim_in_order, greedy_leaders


def groups_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["group_key"], []).append((r["seq"], r["id"]))
    return {k: [i for _, i in sorted(v)] for k, v in found.items()}


def test_dedup_keeps_first_and_counts(spark):
    links = make_links(spark, ["https://a.com/x/", "https://a.com/x", "https://www.a.com/x", "https://a.com/x#f", "http://bad host", "http://bad host"])
    pairs = {(r["keep_id"], r["duplicate_id"]) for r in dedup.duplicate_groups(links).collect()}
    assert pairs == {("L0", "L1"), ("L0", "L3"), ("L4", "L5")}
    assert {(r["keep_id"], r["duplicate_id"]) for r in dedup.duplicate_groups(links, "smart").collect()} == {("L0", "L1"), ("L0", "L2"), ("L4", "L5")}
    assert {(r["keep_id"], r["duplicate_id"]) for r in dedup.duplicate_groups(links, "strict").collect()} == {("L4", "L5")}
    assert dedup.dedup_preview(links).first().asDict() == {"group_count": 2, "duplicate_count": 3, "remaining_count": 3}


def test_dedup_sort_decides_which_row_stays(spark):
    links = make_links(spark, ["https://a.com/b#z", "https://a.com/b#a"])
    assert dedup.duplicate_groups(links, sort="original").first()["keep_id"] == "L0"
    assert dedup.duplicate_groups(links, sort="alphabetical").first()["keep_id"] == "L1"
    with pytest.raises(ValueError):
        dedup.duplicate_groups(links, sort="size")


def test_dedup_leaves_one_active_row_per_key_and_is_stable(spark):
    links = make_links(spark, [f"https://a.com/{i % 7}" for i in range(40)])
    once = dedup.dedup_execute(links)
    assert once.filter("status = 'imported'").count() == 7
    assert dedup.duplicate_groups(once).count() == 0
    assert {r["duplicate_of"] for r in once.filter("duplicate_of IS NOT NULL").collect()} == {f"L{i}" for i in range(7)}
    again = dedup.dedup_execute(once)
    assert sorted(again.select("id", "status", "duplicate_of").collect()) == sorted(once.select("id", "status", "duplicate_of").collect())


def test_hot_keys_take_the_broadcast_path(spark, monkeypatch):
    """The same rows come out whether keys count as hot or not, and with NULL keys."""
    # Few keys would be sent whole; this is about more of them.
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 0)
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 17 = 0 THEN NULL ELSE concat('k', id % 500) END AS k")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    plain = skew.attach_by_key(rows, per_key, "k", F.col("id"))
    hot = skew.attach_by_key(rows, per_key, "k", F.col("id"), hot_rows=500)
    want = {r["k"]: (r["n"], r["first"]) for r in per_key.collect() if r["k"] is not None}
    for df in (plain, hot):
        got = df.collect()
        assert len(got) == 3000
        assert all((r["n"], r["first"]) == want.get(r["k"], (None, None)) for r in got)
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # The slot must survive optimisation as a join key, or the hot rows would meet in one task.
    assert re.search(r"(?:SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[k#\d+, __slot#\d+L\]", plan), plan
    # In the shuffled join, rows of the hot key go to many slots.
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    keys = spark.createDataFrame([("hot",), ("k1",)], "k string")
    assert skew.semi_by_key(rows, keys, "k", F.col("id")).count() == 1000 + rows.filter("k = 'k1'").count()
    assert skew.anti_by_key(rows, keys, "k", F.col("id")).count() == 3000 - 1000 - rows.filter("k = 'k1'").count()


def test_few_keys_move_no_rows(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END AS k")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = skew.attach_by_key(rows, per_key, "k", F.col("id"))
    sizes = {r["k"]: r["n"] for r in per_key.collect() if r["k"] is not None}
    assert all(r["n"] == sizes.get(r["k"]) for r in joined.collect()) and joined.count() == 3000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_positions_ranks_and_running_totals(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 AS v", "concat('g', id % 3) AS g", "id % 5 = 0 AS odd").repartition(7)
    placed = ordering.with_global_position(df, ["v"]).collect()
    assert all(r["pos"] == r["v"] for r in placed)
    ranked = ordering.with_rank_in_group(df, "g", "id", "rank", F.col("odd"), width=16).collect()
    for g in ("g0", "g1", "g2"):
        mine = sorted((r["id"], r["rank"]) for r in ranked if r["g"] == g and r["odd"])
        assert [k for _, k in mine] == list(range(len(mine)))
    assert all(r["rank"] is None for r in ranked if not r["odd"])
    totals = ordering.with_running_total(df, ["v"], "v", "before").collect()
    assert all(r["before"] == r["v"] * (r["v"] - 1) // 2 for r in totals)


def test_domain_and_path_groups(spark):
    links = make_links(spark, [
        "https://example.com/a/b/c/d", "https://example.com/a/b/x/y", "https://example.com/a/z/p/q",
        "https://b.com/p/z", "not a url", "also not", "https://www.b.com/p/z/1",
    ])
    assert groups_of(similarity.group_by_domain(links)) == {"example.com": ["L0", "L1", "L2"], "": ["L4", "L5"]}
    assert groups_of(similarity.group_by_path_prefix(links)) == {"example.com/a/b": ["L0", "L1"], "b.com/p/z": ["L3", "L6"]}
    assert groups_of(similarity.group_by_path_prefix(links, 1)) == {"example.com/a": ["L0", "L1", "L2"], "b.com/p": ["L3", "L6"]}
    # The domain keeps www, the path key does not: what the first layer leaves can still pair.
    layered = similarity.detect_similarity(links).collect()
    assert {r["id"] for r in layered if r["layer"] == 1} == {"L3", "L6"}


SIMILAR = [
    ("abc", "abc", 0.99, True), ("", "", 0.99, True), ("ab", "abcdefghij", 0.9, False), ("abc", "abd", 1.0, False),
    ("abc", "xyz", 0.0, True), ("abcdefghij", "abcdefghiX", 0.8, True), ("abcdefghij", "XXXXXfghij", 0.8, False),
    ("a" * 100, "b" * 100, 0.8, False), ("abc", "ábč", 0.5, False),
]


@pytest.mark.parametrize("a, b, threshold, expected", SIMILAR)
def test_similar_enough(spark, a, b, threshold, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    both = df.select(
        similarity.similar_enough(F.col("a"), F.col("b"), threshold), similarity.similar_enough(F.col("b"), F.col("a"), threshold)
    ).first()
    assert tuple(both) == (expected, expected)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_clusters(links, threshold, window):
    """Greedy leaders, one domain after the other, as plain loops."""
    import math

    found = {}
    for domain in {d for d, _, _, _ in links}:
        rows = sorted((u, s, i) for d, u, s, i in links if d == domain)
        taken = set()
        for a in range(len(rows)):
            if a in taken:
                continue
            members = []
            for b in range(a + 1, min(a + window, len(rows))):
                x, y = rows[a][0], rows[b][0]
                longer = max(len(x), len(y))
                d = distance(x, y)
                if b not in taken and (d == 0 or (d <= math.floor((1 - threshold) * longer) and 1 - d / longer >= threshold)):
                    members.append(rows[b][2])
                    taken.add(b)
            if members:
                found[rows[a][2]] = {rows[a][2], *members}
    return found


@pytest.mark.parametrize("window, chunk", [(200, leaders.CHUNK), (9, 9)])
def test_edit_distance_clusters_match_brute_force(spark, window, chunk):
    rng = random.Random(5)
    urls = [
        f"https://{rng.choice(['a.com', 'bb.org'])}/{rng.choice(['item', 'itm', 'page'])}/{rng.randrange(1000)}{rng.choice(['', 'x' * 9])}"
        for _ in range(150)
    ]
    links = make_links(spark, urls)
    got = {}
    for r in similarity.edit_distance_clusters(links, 0.9, "binary", window, chunk).collect():
        got.setdefault(r["keep_id"], set()).add(r["id"])
        assert r["group_key"] == "edit_distance_" + r["keep_id"]
    rows = [(r["domain"], r["normalized_url"], r["seq"], r["id"]) for r in links.collect()]
    want = brute_clusters(rows, 0.9, window)
    assert got == want and len(want) > 5


@pytest.mark.parametrize("window, chunk", [(5, 3), (7, 16), (200, 50)])
def test_clusters_of_repeated_urls_match_brute_force(spark, window, chunk):
    """Runs of equal URLs longer than windows and chunks, with similar ones around them."""
    rng = random.Random(11)
    urls = [
        f"https://{rng.choice(['a.com', 'b.org'])}/{rng.choice(['item', 'itm', 'page'])}/{rng.choice(['1', '12', '13', '140'])}{rng.choice(['', '', 'xxxxxxx'])}"
        for _ in range(220)
    ]
    links = make_links(spark, urls)
    got = {}
    for r in similarity.edit_distance_clusters(links, 0.9, "binary", window, chunk).collect():
        got.setdefault(r["keep_id"], {}).setdefault(r["group_size"], set()).add(r["id"])
    rows = [(r["domain"], r["normalized_url"], r["seq"], r["id"]) for r in links.collect()]
    want = brute_clusters(rows, 0.9, window)
    assert {k: v for k, sizes in got.items() for v in sizes.values()} == want
    assert all(len(sizes) == 1 and set(sizes) == {len(want[k])} for k, sizes in got.items())


def test_equal_urls_make_no_band_of_pairs(spark):
    links = spark.range(100_000).selectExpr(
        "id AS seq", "concat('L', id) AS id", "'a.com' AS domain", "'https://a.com/' AS normalized_url", "'https://a.com/' AS original_url"
    )
    nodes = similarity.url_runs(similarity.positioned(links, "binary"))
    assert [tuple(r) for r in similarity.similar_runs(nodes).collect()] == [(0, 99_999, 0, 99_999)]
    sizes = similarity.edit_distance_clusters(links, order="binary").groupBy("group_key", "group_size").count().collect()
    assert len(sizes) == 500 and {(r["group_size"], r["count"]) for r in sizes} == {(200, 200)}


def test_leaders_see_one_row_a_run(spark, monkeypatch):
    """All URLs of a window are similar here: 199 pairs a link, of which no row may go to the tasks that choose leaders."""
    links = spark.range(1000).selectExpr(
        "id AS seq", "concat('L', id) AS id", "'a.com' AS domain", "concat('https://a.com/article/', 10000 + id) AS normalized_url", "'x' AS original_url"
    )
    seen = []

    def spy(bands, *rest):
        seen.append(bands.count())
        return leaders.greedy_run_leaders(bands, *rest)

    monkeypatch.setattr(similarity, "greedy_run_leaders", spy)
    for chunk in (64, leaders.CHUNK):
        found = similarity.edit_distance_clusters(links, order="binary", chunk=chunk).collect()
        assert {r["keep_id"] for r in found} == {f"L{200 * k}" for k in range(5)} and len(found) == 1000
    assert max(seen) <= 1000


def test_early_answers_agree_with_the_distance(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(9)))
    rows = [(k, f"{p}{word()}", f"{p}{word()}") for k in range(300) for p in [word() + word()]]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for t in (0.0, 0.5, 0.7, 0.8, 0.9, 1.0):
        got = {r["k"]: r["s"] for r in df.select("k", similarity.similar_enough(F.col("a"), F.col("b"), t).alias("s")).collect()}
        for k, a, b in rows:
            longer, d = max(len(a), len(b)), distance(a, b)
            assert got[k] == (a == b or (d <= int((1 - t) * longer) and 1 - d / longer >= t)), (t, a, b)


def test_leaders_over_many_small_chunks(spark):
    """Random banded graphs, long chains included, against one pass over all edges."""
    rng = random.Random(1)
    for density in (0.1, 0.5, 1.0):
        edges = [(i, j) for i in range(120) for j in range(i + 1, min(i + 6, 120)) if rng.random() < density]
        want = claim_in_order(pd.DataFrame(sorted(edges), columns=["i", "j"]), {})
        df = spark.createDataFrame(edges, "i long, j long")
        got = {r["member"]: r["leader"] for r in greedy_leaders(df, chunk=10).collect()}
        assert got == want


def test_filter_similar_keeps_first_and_respects_selection(spark):
    links = make_links(spark, ["https://a.com/p/q/1", "https://a.com/p/q/2", "https://b.com/p/q/1", "https://b.com/p/q/2"])
    layer = [Layer("path_prefix")]
    done = {r["id"]: (r["status"], r["similarity_group"], r["duplicate_of"]) for r in transitions.filter_similar_execute(links, layer).collect()}
    assert done["L0"] == ("imported", "a.com/p/q", None)
    assert done["L1"] == ("filtered_similar", "a.com/p/q", "L0")
    one = spark.createDataFrame([("b.com/p/q",)], "group_key string")
    chosen = transitions.filter_similar_execute(links, layer, selected=one)
    assert {r["id"] for r in chosen.filter("status = 'filtered_similar'").collect()} == {"L3"}
    assert transitions.filter_similar_execute(links, layer, selected=one.limit(0)).filter("status != 'imported'").count() == 0
    # With given ids the newest link comes first and is kept.
    some = links.select("id").filter("id IN ('L0', 'L1')")
    newest = transitions.filter_similar_execute(links, layer, ids=some)
    assert {r["id"] for r in newest.filter("status = 'filtered_similar'").collect()} == {"L0"}


def test_flags_and_pages(spark):
    assert [x.method for x in similarity.layers_from_flags()] == ["domain", "path_prefix"]
    assert [x.method for x in similarity.layers_from_flags(False, False)] == ["domain", "path_prefix"]
    assert [x.method for x in similarity.layers_from_flags(False, False, edit_distance=True)] == ["edit_distance"]
    links = make_links(spark, ["https://a.com/1", "https://b.com/1", "https://b.com/2", "https://a.com/2", "https://a.com/3", "https://c.com/"])
    first = similarity.bucket_page(links, 0, 1).first()
    assert (first["domain"], first["n"], first["total_domains"], first["has_more"]) == ("b.com", 2, 2, True)
    assert similarity.bucket_page(links, 1, 1).first()["has_more"] is False
    assert {r["id"] for r in similarity.edit_distance_page(links, 0, 1).collect()} == {"L1", "L2"}
    view = similarity.grouped_view(links).collect()
    assert [(r["view_key"], r["place"], r["group_size"]) for r in view][:2] == [("a.com", 1, 3), ("a.com", 2, 3)]
