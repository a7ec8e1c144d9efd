"""Duplicates and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from hrefmill.catalog import fixtures as fx
from hrefmill.catalog.registry import query, text
from hrefmill.functions.urls import NormalizeConfig
from hrefmill.operators import dedup, similarity, transitions
from hrefmill.operators.similarity import Layer

L, C = fx.LINKS_SQL, fx.CURATED_SQL
ACTIVE = "status NOT IN ('duplicate_removed', 'filtered_internal', 'filtered_similar')"


def _groups_sql(key: str, order: str = "seq") -> str:
    return text(
        L,
        f"""SELECT {key} AS normalized_url, keep_id, keep_url, keep_seq, group_size, id AS duplicate_id, original_url AS duplicate_url, seq AS duplicate_seq
            FROM (SELECT *, first_value(id) OVER w AS keep_id, first_value(original_url) OVER w AS keep_url, first_value(seq) OVER w AS keep_seq,
                         count(*) OVER (PARTITION BY {key}) AS group_size FROM links WINDOW w AS (PARTITION BY {key} ORDER BY {order}))
            WHERE group_size > 1 AND id <> keep_id""",
    )


@query("F6_duplicate_groups", _groups_sql("dedup_key"))
def groups(spark, sf):
    return dedup.duplicate_groups(fx.links(spark, sf))


@query("F6_duplicate_groups_strict", _groups_sql("original_url"))
def groups_strict(spark, sf):
    return dedup.duplicate_groups(fx.links(spark, sf), "strict")


@query("F6_duplicate_groups_smart", _groups_sql("smart_key"))
def groups_smart(spark, sf):
    return dedup.duplicate_groups(fx.links(spark, sf), "smart")


@query(
    "F6_dedup_preview",
    text(L, """SELECT count(*) FILTER (WHERE n > 1) AS group_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, count(*) AS remaining_count
               FROM (SELECT count(*) AS n FROM links GROUP BY dedup_key)"""),
)
def preview(spark, sf):
    return dedup.dedup_preview(fx.links(spark, sf))


@query("G1_keep_first", text(C, "SELECT id, keep_id FROM marked"))
def keep_first(spark, sf):
    marked = dedup.dedup_execute(fx.links(spark, sf))
    return marked.select("id", F.coalesce("duplicate_of", "id").alias("keep_id"))


@query("H4_dedup_sort_domain", _groups_sql("dedup_key", "domain, seq"))
def sort_domain(spark, sf):
    return dedup.duplicate_groups(fx.links(spark, sf), sort="domain")


@query("H4_dedup_sort_alphabetical")
def sort_alphabetical(spark, sf):
    return dedup.duplicate_groups(fx.links(spark, sf), sort="alphabetical")


@query("J2_dedup_execute", text(L, "SELECT id, CASE WHEN id <> keep_id THEN 'duplicate_removed' ELSE status END AS status, CASE WHEN id <> keep_id THEN keep_id END AS duplicate_of FROM (SELECT *, first_value(id) OVER (PARTITION BY dedup_key ORDER BY seq) AS keep_id FROM links)"))
def execute(spark, sf):
    return dedup.dedup_execute(fx.links(spark, sf)).select("id", "status", "duplicate_of")


# --- similarity ---

PATHS = """
paths AS (
  SELECT *, CASE WHEN url_path IS NOT NULL THEN regexp_extract(normalized_url, '^[a-z]+://([^/:?#]+)', 1) || '/' ||
            array_to_string(list_filter(string_split(regexp_extract(normalized_url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/'), lambda x: x <> '')[1:2], '/') END AS path_key
  FROM links
)"""


def _members_sql(source: str, key: str, method: str) -> str:
    return f"""SELECT '{method}' AS method, {key} AS group_key, group_size, keep_id, keep_seq, id, seq, original_url
        FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS group_size, first_value(id) OVER (PARTITION BY {key} ORDER BY seq) AS keep_id,
                     min(seq) OVER (PARTITION BY {key}) AS keep_seq FROM {source} WHERE {key} IS NOT NULL) WHERE group_size > 1"""


@query("C7_path_prefix_key", text(L, "SELECT id, path_key FROM paths", PATHS))
def path_key(spark, sf):
    return similarity.with_path_key(fx.links(spark, sf)).select("id", "path_key")


@query("F7_group_by_domain", text(L, _members_sql("links", "domain", "domain")))
def by_domain(spark, sf):
    return similarity.group_by_domain(fx.links(spark, sf))


@query("F8_group_by_path_prefix", text(L, _members_sql("paths", "path_key", "path_prefix"), PATHS))
def by_path(spark, sf):
    return similarity.group_by_path_prefix(fx.links(spark, sf))


SIMILAR = """(a = b OR (abs(length(a) - length(b)) <= floor(0.19999999999999996::DOUBLE * greatest(length(a), length(b)))
  AND levenshtein(a, b) <= floor(0.19999999999999996::DOUBLE * greatest(length(a), length(b)))
  AND 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE >= 0.8::DOUBLE))"""


@query("C8_similar_enough", f"SELECT page_id, {SIMILAR} AS similar FROM (SELECT p.page_id, p.url AS a, q.url AS b FROM pages p JOIN pages q ON q.page_id = p.page_id + 1)")
def similar(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    return pages.join(nxt, "page_id").select("page_id", similarity.similar_enough(F.col("url"), F.col("next_url"), 0.8).alias("similar"))


NODES = """
nodes AS (SELECT row_number() OVER (ORDER BY domain, normalized_url, seq) - 1 AS pos, id, seq, domain, normalized_url, original_url FROM links)"""


@query(
    "E7_similar_pairs",
    text(L, f"SELECT i, j FROM (SELECT x.pos AS i, y.pos AS j, x.normalized_url AS a, y.normalized_url AS b FROM nodes x JOIN nodes y ON x.domain = y.domain AND y.pos > x.pos AND y.pos - x.pos < 200) WHERE {SIMILAR}", NODES),
)
def pairs(spark, sf):
    return similarity.similar_pairs(similarity.positioned(fx.links(spark, sf), "binary"))


@query("G3_neighbour_position", text(L, "SELECT id, domain, pos FROM nodes", NODES))
def neighbours(spark, sf):
    return similarity.positioned(fx.links(spark, sf), "binary").select("id", "domain", "pos")


_SIM = SIMILAR.replace("(a = b", "(rem[1].u = x.u").replace("length(a)", "length(rem[1].u)").replace("length(b)", "length(x.u)").replace("levenshtein(a, b)", "levenshtein(rem[1].u, x.u)")
CLUSTERS = f"""
steps AS (
  SELECT domain, list(struct_pack(pos := pos, id := id, u := normalized_url) ORDER BY pos) AS rem,
         CAST(NULL AS VARCHAR) AS lead, CAST([] AS VARCHAR[]) AS members
  FROM nodes GROUP BY domain
  UNION ALL
  SELECT domain, list_filter(rem[2:], lambda x: NOT (x.pos - rem[1].pos < 200 AND {_SIM})), rem[1].id,
         list_transform(list_filter(rem[2:], lambda x: x.pos - rem[1].pos < 200 AND {_SIM}), lambda x: x.id)
  FROM steps WHERE len(rem) > 0
),
clusters AS (
  SELECT lead AS keep_id, unnest(list_concat([lead], members)) AS id, CAST(len(members) + 1 AS BIGINT) AS group_size
  FROM steps WHERE len(members) > 0
)"""


@query(
    "F9_edit_distance_clusters",
    text(L, "SELECT 'edit_distance_' || keep_id AS group_key, keep_id, id, group_size FROM clusters", NODES, CLUSTERS).replace("WITH ", "WITH RECURSIVE ", 1),
)
def clusters(spark, sf):
    found = similarity.edit_distance_clusters(fx.links(spark, sf), order="binary")
    return found.select("group_key", "keep_id", "id", "group_size")


@query("F9_edit_distance_clusters_locale")
def clusters_locale(spark, sf):
    return similarity.edit_distance_clusters(fx.links(spark, sf)).select("group_key", "keep_id", "id", "group_size")


LAYERED = f"""
first_layer AS ({_members_sql('links', 'domain', 'domain')}),
left_over AS (SELECT * FROM paths WHERE id NOT IN (SELECT id FROM first_layer)),
second_layer AS ({_members_sql('left_over', 'path_key', 'path_prefix')})"""


@query("F10_layered_similarity", text(L, "SELECT 0 AS layer, * FROM first_layer UNION ALL SELECT 1, * FROM second_layer", PATHS, LAYERED))
def layered(spark, sf):
    return similarity.detect_similarity(fx.links(spark, sf))


@query("I5_union_of_layers", text(L, "SELECT id, method FROM first_layer UNION ALL SELECT id, method FROM second_layer", PATHS, LAYERED))
def union_layers(spark, sf):
    return similarity.detect_similarity(fx.links(spark, sf)).select("id", "method")


@query("F10_three_layers")
def three_layers(spark, sf):
    layers = [Layer("path_prefix"), Layer("edit_distance", order="binary"), Layer("domain")]
    return similarity.detect_similarity(fx.links(spark, sf), layers)


@query(
    "F11_similar_preview",
    text(L, "SELECT count(*) FILTER (WHERE id = keep_id) AS group_count, count(*) FILTER (WHERE id <> keep_id) AS total_similar FROM (SELECT id, keep_id FROM first_layer UNION ALL SELECT id, keep_id FROM second_layer)", PATHS, LAYERED),
)
def similar_preview(spark, sf):
    return similarity.similar_preview(fx.links(spark, sf))


_EDIT_LAYER = f"""
path_layer AS ({_members_sql('paths', 'path_key', 'path_prefix')}),
rest_one AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM path_layer)),
{NODES.strip().replace('FROM links', 'FROM rest_one')},{CLUSTERS},
edit_layer AS (
  SELECT 'edit_distance' AS method, 'edit_distance_' || c.keep_id AS group_key, group_size, c.keep_id, k.seq AS keep_seq, n.id, n.seq, n.original_url
  FROM clusters c JOIN nodes n ON n.id = c.id JOIN nodes k ON k.id = c.keep_id
),
rest_two AS (SELECT * FROM rest_one WHERE id NOT IN (SELECT id FROM edit_layer)),
last_layer AS ({_members_sql('rest_two', 'domain', 'domain')})"""


@query(
    "F10_three_layers_in_turn",
    text(L, "SELECT 0 AS layer, * FROM path_layer UNION ALL SELECT 1, * FROM edit_layer UNION ALL SELECT 2, * FROM last_layer", PATHS, _EDIT_LAYER).replace("WITH ", "WITH RECURSIVE ", 1),
)
def three_layers_in_turn(spark, sf):
    layers = [Layer("path_prefix"), Layer("edit_distance", order="binary"), Layer("domain")]
    return similarity.detect_similarity(fx.links(spark, sf), layers)


@query(
    "F11_similar_groups_page",
    text(L, """SELECT group_no, layer, method, group_key, group_size, keep_id, keep_seq, id, seq, original_url, total_groups, total_similar, 12::BIGINT AS next_cursor
               FROM (SELECT *, dense_rank() OVER (ORDER BY layer, keep_seq) - 1 AS group_no, count(*) FILTER (WHERE id = keep_id) OVER () AS total_groups,
                            count(*) FILTER (WHERE id <> keep_id) OVER () AS total_similar
                     FROM (SELECT 0 AS layer, * FROM first_layer UNION ALL SELECT 1, * FROM second_layer)) WHERE group_no BETWEEN 4 AND 11""", PATHS, LAYERED),
)
def groups_page(spark, sf):
    return similarity.similar_groups_page(fx.links(spark, sf), cursor=4, limit=8)


@query(
    "L2_layers_from_flags",
    text(L, f"SELECT 0 AS layer, * FROM ({_members_sql('shallow', 'k', 'path_prefix')})", PATHS, "shallow AS (SELECT *, regexp_extract(path_key, '^([^/]*/[^/]*)', 1) AS k FROM paths)"),
)
def flagged_layers(spark, sf):
    """Only the path layer, one segment deep."""
    layers = similarity.layers_from_flags(by_domain=False, path_depth=1)
    return similarity.detect_similarity(fx.links(spark, sf), layers)


@query(
    "L2_added_layer",
    text(L, f"SELECT 0 AS layer, * FROM ({_members_sql('titled', 'k', 'title')})", "titled AS (SELECT *, nullif(lower(title), '') AS k FROM links)"),
)
def added_layer(spark, sf):
    """A method that the library does not have, added under a name of its own."""
    titles = fx.links(spark, sf).select("id", F.nullif(F.lower("title"), F.lit("")).alias("__title"))
    by_title = lambda links, layer: similarity.keyed_layer(links.join(titles, "id"), "__title", "title").drop("__title")
    return similarity.detect_similarity(fx.links(spark, sf), [Layer("title")], methods={"title": by_title})


@query("L3_dedup_with_own_config", text(L, """SELECT count(*) FILTER (WHERE n > 1) AS group_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count, count(*) AS remaining_count
       FROM (SELECT normalized_url, count(*) AS n FROM links GROUP BY normalized_url)"""))
def own_config(spark, sf):
    """Switches that no preset of deduplication has: www goes, the order of the query stays."""
    config = NormalizeConfig(remove_www=True, remove_trailing_slash=True, remove_default_port=True, remove_fragment=True)
    return dedup.dedup_preview(fx.links(spark, sf), config)


@query("F18_domain_buckets", text(C, "SELECT domain, count(*) AS n, min(seq) AS first_seq FROM curated GROUP BY domain HAVING count(*) > 1"))
def buckets(spark, sf):
    return similarity.domain_buckets(fx.curated(spark, sf))


@query(
    "H6_bucket_page",
    text(C, """SELECT domain, n, first_seq, total_domains, total_domains > 25 AS has_more FROM
               (SELECT *, count(*) OVER () AS total_domains, row_number() OVER (ORDER BY n, first_seq) AS rn
                FROM (SELECT domain, count(*) AS n, min(seq) AS first_seq FROM curated GROUP BY domain HAVING count(*) > 1)) WHERE rn BETWEEN 6 AND 25"""),
)
def bucket_page(spark, sf):
    return similarity.bucket_page(fx.curated(spark, sf), 5, 20).drop("next_cursor")


@query(
    "H6_all_pages_by_cursor",
    text(C, "SELECT domain, n, (rn - 1) // 40 AS page FROM (SELECT *, row_number() OVER (ORDER BY n, first_seq) AS rn FROM (SELECT domain, count(*) AS n, min(seq) AS first_seq FROM curated GROUP BY domain HAVING count(*) > 1))"),
)
def pages_by_cursor(spark, sf):
    """Every page, each found by the cursor that the page before it gave."""
    out, cursor, number = None, 0, 0
    while cursor is not None:
        page = similarity.bucket_page(fx.curated(spark, sf), cursor, 40)
        rows = page.select("domain", "n", F.lit(number).cast("bigint").alias("page"))
        out = rows if out is None else out.unionByName(rows)
        first = page.first()
        cursor, number = (first["next_cursor"] if first else None), number + 1
    return out


@query("F11_edit_distance_page")
def edit_page(spark, sf):
    return similarity.edit_distance_page(fx.links(spark, sf), 0, 50).select("group_key", "id", "group_size")


SIMILAR_STATE = """
ranked AS (SELECT *, CASE WHEN path_key IS NOT NULL THEN count(*) OVER (PARTITION BY path_key) END AS n, first_value(id) OVER (PARTITION BY path_key ORDER BY seq) AS lead FROM paths),
similar_state AS (
  SELECT * REPLACE (CASE WHEN n > 1 AND id <> lead THEN 'filtered_similar' ELSE status END AS status,
                    CASE WHEN n > 1 THEN path_key END AS similarity_group,
                    CASE WHEN n > 1 AND id <> lead THEN lead END AS duplicate_of) FROM ranked
)"""


def _filtered(spark, sf):
    return transitions.filter_similar_execute(fx.links(spark, sf), [Layer("path_prefix")])


@query("J4_filter_similar_execute", text(L, "SELECT id, status, similarity_group, duplicate_of FROM similar_state", PATHS, SIMILAR_STATE))
def filter_similar(spark, sf):
    return _filtered(spark, sf).select("id", "status", "similarity_group", "duplicate_of")


@query(
    "E10_selected_groups",
    text(L, "SELECT id, CASE WHEN similarity_group LIKE 'blog.%' THEN status ELSE 'imported' END AS status, CASE WHEN similarity_group LIKE 'blog.%' THEN similarity_group END AS similarity_group FROM similar_state", PATHS, SIMILAR_STATE),
)
def selected(spark, sf):
    links = fx.links(spark, sf)
    keys = similarity.group_by_path_prefix(links).select("group_key").distinct().filter(F.col("group_key").startswith("blog."))
    done = transitions.filter_similar_execute(links, [Layer("path_prefix")], selected=keys)
    return done.select("id", "status", "similarity_group")


@query(
    "F16_grouped_view",
    text(L, """SELECT view_key, place, id, original_url, group_size, seq FROM (
                 SELECT *, row_number() OVER (PARTITION BY view_key ORDER BY seq) AS place, count(*) OVER (PARTITION BY view_key) AS group_size
                 FROM (SELECT *, coalesce(nullif(similarity_group, ''), domain) AS view_key FROM similar_state)) WHERE place <= 3""", PATHS, SIMILAR_STATE),
)
def grouped_view(spark, sf):
    shown = similarity.grouped_view(_filtered(spark, sf))
    return shown.withColumn("place", F.col("place").cast("bigint"))


@query("E9_group_member_urls", text(L, _members_sql("paths", "path_key", "path_prefix").replace("SELECT 'path_prefix' AS method, path_key AS group_key, group_size, keep_id, keep_seq, id, seq, original_url", "SELECT path_key AS group_key, id, original_url"), PATHS))
def member_urls(spark, sf):
    return similarity.group_by_path_prefix(fx.links(spark, sf)).select("group_key", "id", "original_url")
