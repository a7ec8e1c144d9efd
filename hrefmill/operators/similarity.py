"""Near duplicates: by domain, by path prefix, by edit distance, or in layers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.functions.urls import path_prefix_key, with_url_parts
from hrefmill.operators.listing import scan_active_links
from hrefmill.plans.leaders import RUN_CHUNK, greedy_run_leaders, words_of
from hrefmill.plans.ordering import with_global_position
from hrefmill.plans.skew import attach_by_key
from hrefmill.storage import cut_lineage

WINDOW = 200
MAX_PAGE = 500
GROUP_COLUMNS = ["method", "group_key", "group_size", "keep_id", "keep_seq", "id", "seq", "original_url"]


@dataclass(frozen=True)
class Layer:
    """One similarity method; ``order`` is the sort used by edit distance (locale or binary).

    ``resolve`` makes the path layer canonicalise raw URLs (see ``with_path_key``).
    """

    method: str
    path_depth: int = 2
    threshold: float = 0.8
    order: str = "locale"
    resolve: bool = True


DEFAULT_LAYERS = [Layer("domain"), Layer("path_prefix")]


def layers_from_flags(
    by_domain: bool = True,
    by_path_prefix: bool = True,
    path_depth: int = 2,
    edit_distance: bool = False,
    threshold: float = 0.8,
) -> list[Layer]:
    chosen = []
    if by_domain:
        chosen.append(Layer("domain"))
    if by_path_prefix:
        chosen.append(Layer("path_prefix", path_depth=path_depth))
    if edit_distance:
        chosen.append(Layer("edit_distance", threshold=threshold))
    return chosen or DEFAULT_LAYERS


def similar_enough(a: Column, b: Column, threshold: float, lengths: tuple[Column, Column] | None = None) -> Column:
    """Equal, or edit distance within ``floor((1 - t) * longer)`` and ratio at least ``t``.

    The length test comes first (``lengths`` where they are known). Texts that differ in their last ``allowed`` characters only
    are that close at most, so that they need no distance; for all others it stops counting at the bound.
    """
    m, n = lengths or (F.length(a), F.length(b))
    longer = F.greatest(m, n)
    allowed = F.floor(F.lit(1 - threshold) * longer).cast("int")
    distance = F.call_function("levenshtein", a, b, allowed)
    close_front = (F.left(a, longer - allowed) == F.left(b, longer - allowed)) & (1 - allowed / longer >= F.lit(threshold))
    close = F.when(
        F.abs(m - n) <= allowed,
        F.when(close_front, True).otherwise((distance >= 0) & (1 - distance / longer >= F.lit(threshold))),
    ).otherwise(False)
    return F.when(a == b, True).otherwise(close)


def _grouped_by(links: DataFrame, key: str, method: str) -> DataFrame:
    """Members of every key with at least two links; rows with a NULL key stay ungrouped."""
    # NULL keys form a group of their own that no row can join; a filter on the key would be pushed
    # below the projections that compute it.
    per_key = (
        links.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"), F.min_by("id", "seq").alias("__keep"), F.min("seq").alias("__keep_seq"))
        .filter("__n > 1")
    )
    return attach_by_key(links, per_key, key, F.col("seq"), size="__n").withColumns(
        {
            "method": F.when(F.col("__n").isNotNull(), method),
            "group_key": F.when(F.col("__n").isNotNull(), F.col(key)),
            "group_size": F.col("__n"),
            "keep_id": F.col("__keep"),
            "keep_seq": F.col("__keep_seq"),
        }
    ).drop("__n", "__keep", "__keep_seq")


def with_path_key(links: DataFrame, depth: int = 2, out: str = "path_key", resolve: bool = True) -> DataFrame:
    """Host and first path segments of the normalised URL.

    Strict imports store raw URLs, so they are resolved; ``resolve=False`` skips that where all
    stored URLs are canonical, and with it the only Python stage.
    """
    parsed = with_url_parts(links, "normalized_url", "__p_", resolve)
    return parsed.withColumn(out, path_prefix_key(F.col("__p_host"), F.col("__p_path"), depth)).select(*links.columns, out)


def group_by_domain(links: DataFrame) -> DataFrame:
    keyed = links.withColumn("__key", F.coalesce("domain", F.lit("")))
    return _grouped_by(keyed, "__key", "domain").filter("method IS NOT NULL").select(*GROUP_COLUMNS)


def group_by_path_prefix(links: DataFrame, depth: int = 2, resolve: bool = True) -> DataFrame:
    # A malformed URL gets a key of its own: it groups with nothing and needs no NULL test.
    alone = F.coalesce("__key", F.concat(F.lit("\u0001"), F.col("id")), F.lit(""))
    keyed = with_path_key(links, depth, "__key", resolve).withColumn("__key", alone)
    return _grouped_by(keyed, "__key", "path_prefix").filter("method IS NOT NULL").select(*GROUP_COLUMNS)


def positioned(links: DataFrame, order: str = "locale") -> DataFrame:
    """Links with ``pos``, their place when sorted by domain, normalised URL and ``seq``."""
    if order not in ("locale", "binary"):
        raise ValueError(f"unknown order: {order}")
    narrow = links.select("id", "seq", "domain", "normalized_url", "original_url")
    if order == "binary":
        return with_global_position(narrow, ["domain", "normalized_url", "seq"])
    ranked = narrow.withColumn("__rank", F.collate("normalized_url", "UNICODE"))
    return with_global_position(ranked, ["domain", "__rank", "seq"]).drop("__rank")


def similar_pairs(nodes: DataFrame, threshold: float = 0.8, window: int = WINDOW) -> DataFrame:
    """Edges ``(i, j)`` of positioned links in one domain, closer than ``window`` and similar enough.

    A bucket holds ``window`` consecutive positions and meets only itself and the next one, so no
    join key carries more than ``window`` by ``2 * window`` candidates, however big the domain.
    """
    bucket = F.floor(F.col("pos") / window)
    # A little data makes a lot of comparisons here, so the tasks must not be merged by data size.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = nodes.select(F.col("pos").alias("i"), "domain", F.col("normalized_url").alias("a"), bucket.alias("b"))
    right = nodes.select(
        F.col("pos").alias("j"),
        "domain",
        F.col("normalized_url").alias("c"),
        F.explode(F.array(bucket, bucket - 1)).alias("b"),
    )
    gap = F.col("j") - F.col("i")
    return (
        left.repartition(tasks, "domain", "b")
        .join(right.repartition(tasks, "domain", "b"), ["domain", "b"])
        .filter((gap > 0) & (gap < window) & similar_enough(F.col("a"), F.col("c"), threshold))
        .select("i", "j")
    )


def url_runs(nodes: DataFrame) -> DataFrame:
    """Positioned links with ``a`` and ``a_end``, the first and last position of the run of equal URLs they are in.

    Equal URLs lie side by side; where a locale order mixes them with others, each link is a run of its own.
    """
    key = F.xxhash64("domain", "normalized_url")
    keyed = nodes.withColumn("__key", key)
    runs = keyed.groupBy("__key").agg(
        F.min("pos").alias("__a"), F.max("pos").alias("__z"), F.count(F.lit(1)).alias("n"),
        F.min("domain").alias("__d0"), F.max("domain").alias("__d1"),
        F.min("normalized_url").alias("__u0"), F.max("normalized_url").alias("__u1"),
    )
    one = F.col("__d0").eqNullSafe(F.col("__d1")) & F.col("__u0").eqNullSafe(F.col("__u1")) & (F.col("__z") - F.col("__a") + 1 == F.col("n"))
    runs = runs.filter((F.col("n") > 1) & one).select("__key", "n", "__a", "__z")
    placed = attach_by_key(keyed, runs, "__key", F.col("pos"))
    return placed.withColumns({"a": F.coalesce("__a", "pos"), "a_end": F.coalesce("__z", "pos")}).select(*nodes.columns, "a", "a_end")


def _close_runs(heads: DataFrame, threshold: float, window: int) -> DataFrame:
    """Pairs ``(domain, __b, a, a_end, b, b_end)`` of similar runs of a domain less than ``window`` apart, dealt by domain and ``__b``."""
    # A little data makes a lot of comparisons here, so the tasks must not be merged by data size.
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = heads.withColumns({"__b": F.floor(F.col("a_end") / window), "__m": F.length("normalized_url")})
    here = F.floor(F.col("a") / window)
    right = heads.select(
        "domain", F.col("normalized_url").alias("__url"), F.length("normalized_url").alias("__n"), F.col("a").alias("b"), F.col("a_end").alias("b_end"),
        F.explode(F.array(here, here - 1)).alias("__b"),
    )
    gap = F.col("b") - F.col("a_end")
    return (
        left.repartition(tasks, "domain", "__b")
        .join(right.repartition(tasks, "domain", "__b"), ["domain", "__b"])
        .filter((gap > 0) & (gap < window) & similar_enough(F.col("normalized_url"), F.col("__url"), threshold, (F.col("__m"), F.col("__n"))))
        .select("domain", "__b", "a", "a_end", "b", "b_end")
    )


def _heads(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("pos") == F.col("a")).select("domain", "normalized_url", "a", "a_end")


def similar_runs(runs: DataFrame, threshold: float = 0.8, window: int = WINDOW) -> DataFrame:
    """Edges ``(a, a_end, b, b_end)`` between similar runs of a domain less than ``window`` apart, and of long runs to themselves.

    As many as there are different URLs side by side: equal ones add none.
    """
    heads = _heads(runs)
    own = heads.filter("a_end > a").select("a", "a_end", F.col("a").alias("b"), F.col("a_end").alias("b_end"))
    return _close_runs(heads, threshold, window).select("a", "a_end", "b", "b_end").unionByName(own)


def run_bands(runs: DataFrame, threshold: float = 0.8, window: int = WINDOW) -> DataFrame:
    """The edges of ``similar_runs`` as bits, one row for each run with a later neighbour and each long run.

    Bit ``d`` of the words ``first0..`` tells that a similar run begins ``d`` positions after ``a_end``, that of ``covered0..``
    that one lies there. Pairs of a run are made in one task, which adds them up: no more than a row a run leaves it.
    """
    heads = _heads(runs)
    bit = lambda of, at: F.call_function("shiftleft", of, at.cast("int"))
    begin, end = F.col("b") - F.col("a_end"), F.least(F.col("b_end") - F.col("a_end"), F.lit(window - 1))
    first, covered = {}, {}
    for w in range(words_of(window)):
        low, high = F.greatest(begin, F.lit(64 * w)), F.least(end, F.lit(64 * w + 63))
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (63 - (high - low)).cast("int"))
        first[f"first{w}"] = F.when(F.floor(begin / 64) == w, bit(F.lit(1).cast("bigint"), begin - 64 * w))
        covered[f"covered{w}"] = F.when(low <= high, bit(ones, low - 64 * w))
    words = first | covered
    none = F.lit(0).cast("bigint")
    pairs = _close_runs(heads, threshold, window).groupBy("domain", "__b", "a", "a_end")
    bands = pairs.agg(*[F.coalesce(F.bit_or(v), none).alias(k) for k, v in words.items()]).drop("domain", "__b")
    return bands.unionByName(heads.filter("a_end > a").select("a", "a_end", *[none.alias(k) for k in words]))


def edit_distance_clusters(
    links: DataFrame, threshold: float = 0.8, order: str = "locale", window: int = WINDOW, chunk: int = RUN_CHUNK
) -> DataFrame:
    """Greedy leader clusters inside each domain; the group key names the leader.

    Equal URLs are one node with a first and last position, so a domain of one URL costs one row, not a band of pairs.
    """
    nodes = cut_lineage(url_runs(positioned(links, order)))
    claims = cut_lineage(greedy_run_leaders(run_bands(nodes, threshold, window), window, chunk))
    leads = claims.groupBy("leader").agg((F.sum(F.col("upto") - F.col("first") + 1) + 1).alias("group_size"))
    keepers = leads.join(
        nodes.select(F.col("pos").alias("leader"), F.col("id").alias("keep_id"), F.col("seq").alias("keep_seq")), "leader"
    )
    # Claims are at most a window long: by pieces of positions no run is joined as a whole.
    piece = lambda c: F.floor(F.col(c) / window)
    spans = claims.withColumn("__piece", F.explode(F.sequence(piece("first"), piece("upto"))))
    placed = nodes.withColumn("__piece", piece("pos")).join(spans.withColumnRenamed("node", "a"), ["a", "__piece"])
    members = placed.filter(F.col("pos").between(F.col("first"), F.col("upto"))).select(*nodes.columns, "leader")
    leaders = nodes.join(leads.select(F.col("leader").alias("pos"), F.col("leader").alias("leader")), "pos").select(*nodes.columns, "leader")
    return (
        members.unionByName(leaders)
        .join(keepers, "leader")
        .withColumns({"method": F.lit("edit_distance"), "group_key": F.concat(F.lit("edit_distance_"), "keep_id")})
        .select(*GROUP_COLUMNS, "pos")
    )


def _edit_layer(links: DataFrame, layer: Layer) -> DataFrame:
    found = edit_distance_clusters(links.filter("method IS NULL"), layer.threshold, layer.order)
    names = ["method", "group_key", "group_size", "keep_id", "keep_seq"]
    fresh = found.select(F.col("id"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = links.join(fresh, "id", "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in names}).select(*links.columns)


def keyed_layer(links: DataFrame, key: Column | str, method: str) -> DataFrame:
    """A layer that groups links by a key; NULL keys group with nothing."""
    names = ["method", "group_key", "group_size", "keep_id", "keep_seq"]
    open_key = F.when(F.col("method").isNull(), F.col(key) if isinstance(key, str) else key)
    before = links.withColumn("__key", open_key).withColumnsRenamed({c: f"was_{c}" for c in names})
    after = _grouped_by(before, "__key", method)
    return after.withColumns({c: F.coalesce(f"was_{c}", c) for c in names}).select(*links.columns)


def _domain_layer(links: DataFrame, layer: Layer) -> DataFrame:
    return keyed_layer(links, "domain", "domain")


def _path_layer(links: DataFrame, layer: Layer) -> DataFrame:
    keyed = with_path_key(links, layer.path_depth, "__path_key", layer.resolve)
    return keyed_layer(keyed, "__path_key", "path_prefix").select(*links.columns)


# A layer maps links with group columns (NULL while ungrouped) to the same with more of them filled.
LAYER_METHODS: dict[str, Callable[[DataFrame, Layer], DataFrame]] = {
    "domain": _domain_layer,
    "path_prefix": _path_layer,
    "edit_distance": _edit_layer,
}


def detect_similarity(
    links: DataFrame, layers: list[Layer] = DEFAULT_LAYERS, methods: dict[str, Callable] = LAYER_METHODS
) -> DataFrame:
    """Group members over all layers, in long form; a link grouped by one layer leaves the next.

    ``layer`` is the position of the layer and ``keep_seq`` orders the groups inside it. Only the columns
    that layers look at go along, and what a layer leaves is kept, so that no layer is computed twice.
    """
    empty = {"method": "string", "group_key": "string", "group_size": "bigint", "keep_id": "string", "keep_seq": "bigint"}
    rest = links.select("id", "seq", "domain", "normalized_url", "original_url")
    out = None
    for number, layer in enumerate(layers):
        tried = rest.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
        done = methods[layer.method](tried, layer)
        if number + 1 < len(layers):
            done = cut_lineage(done)
            rest = done.filter("method IS NULL").drop(*empty)
        found = done.filter("method IS NOT NULL").select(F.lit(number).alias("layer"), *GROUP_COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def similar_groups_page(links: DataFrame, layers: list[Layer] = DEFAULT_LAYERS, cursor: int = 0, limit: int = 20) -> DataFrame:
    """Members of the groups ``[cursor, cursor + limit)``, in the order of layers and of the kept links.

    Every row tells the number of its group, the totals over all groups, and the cursor of the next page (NULL on the last).
    """
    if not 1 <= limit <= MAX_PAGE or cursor < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and cursor not negative")
    members = cut_lineage(detect_similarity(scan_active_links(links), layers))
    kept = members.filter(F.col("id") == F.col("keep_id")).select("layer", "keep_seq", "group_size")
    numbered = with_global_position(kept, ["layer", "keep_seq"], "group_no")
    totals = kept.agg(F.count(F.lit(1)).alias("total_groups"), (F.sum("group_size") - F.count(F.lit(1))).alias("total_similar"))
    shown = numbered.filter(F.col("group_no").between(cursor, cursor + limit - 1)).drop("group_size")
    following = F.when(F.col("total_groups") > cursor + limit, F.lit(cursor + limit).cast("bigint"))
    return (
        members.join(F.broadcast(shown), ["layer", "keep_seq"])
        .join(F.broadcast(totals))
        .select("group_no", "layer", *GROUP_COLUMNS, "total_groups", "total_similar", following.alias("next_cursor"))
    )


def similar_preview(links: DataFrame, layers: list[Layer] = DEFAULT_LAYERS) -> DataFrame:
    """One row: number of groups and of links that would be filtered."""
    members = detect_similarity(scan_active_links(links), layers)
    return members.agg(
        F.count_if(F.col("id") == F.col("keep_id")).alias("group_count"),
        F.count_if(F.col("id") != F.col("keep_id")).alias("total_similar"),
    )


def domain_buckets(links: DataFrame) -> DataFrame:
    """Domains with at least two links, smallest first, ties by first appearance."""
    return (
        links.groupBy("domain")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
        .filter("n > 1")
        .orderBy("n", "first_seq")
    )


def bucket_page(links: DataFrame, cursor: int = 0, batch: int = 50) -> DataFrame:
    """The domains ``[cursor, cursor + batch)`` in bucket order, with the number of all domains."""
    if not 1 <= batch <= MAX_PAGE or cursor < 0:
        raise ValueError(f"batch must be 1..{MAX_PAGE} and cursor not negative")
    buckets = domain_buckets(links)
    total = buckets.agg(F.count(F.lit(1)).alias("total_domains")).withColumn("__one", F.lit(1))
    chosen = buckets.offset(cursor).limit(batch).withColumn("__one", F.lit(1))
    more = F.col("total_domains") > cursor + batch
    return chosen.join(total, "__one").select(
        "domain", "n", "first_seq", "total_domains", more.alias("has_more"),
        F.when(more, F.lit(cursor + batch).cast("bigint")).alias("next_cursor"),
    )


def edit_distance_page(links: DataFrame, cursor: int = 0, batch: int = 50, threshold: float = 0.8) -> DataFrame:
    """Edit-distance clusters of one page of domains; a page holds at most ``MAX_PAGE`` names."""
    chosen = bucket_page(links, cursor, batch).select("domain")
    return edit_distance_clusters(links.join(F.broadcast(chosen), "domain", "left_semi"), threshold)


def grouped_view(links: DataFrame, shown: int = 3) -> DataFrame:
    """Groups by similarity group or else domain, with size and their first links in ``seq`` order.

    The rank filter prunes before the shuffle, so a huge group sends a few rows per task.
    """
    keyed = links.withColumn("view_key", F.coalesce(F.nullif("similarity_group", F.lit("")), "domain"))
    sizes = keyed.groupBy("view_key").agg(F.count(F.lit(1)).alias("group_size"))
    nth = F.row_number().over(W.partitionBy("view_key").orderBy("seq"))
    top = keyed.select("view_key", "seq", "id", "original_url").withColumn("place", nth).filter(F.col("place") <= shown)
    return top.join(sizes, "view_key").orderBy(F.desc("group_size"), "view_key", "place")
