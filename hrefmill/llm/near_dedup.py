"""Near-duplicate classes by ProbMinHash signatures, banding, and exact verification.

A text is a weighted set of shingles: five lower-cased words in a row, weighted by how often they occur
(a text of one to four words is one shingle). ProbMinHash lets every shingle arrive at random registers at the times of
a Poisson process whose rate is its weight and whose random numbers depend on the shingle alone; a register
keeps its first arrival, and a shingle stops once its time is past all registers. Two texts agree in a
register with the probability Jaccard similarity of their weighted sets. ``BANDS`` bands of ``ROWS``
registers make the buckets: a pair at similarity 0.8 shares none with probability 0.738 ** 36, some 2e-5.

Texts that share a bucket are verified exactly: their probability Jaccard is computed from both texts. First
every member of a bucket is verified against the bucket's first one, and links join classes; most buckets lie
in one class then and are done. The others go to tasks in blocks of some two times ``CHUNK`` texts or ``CHUNK_BYTES`` (a larger
bucket in all pairs of its chunks), where every pair of different classes is verified and a union-find keeps only the
links that join two classes. So no pair in a bucket is left out, and none but links leaves a task. Equal texts are one
node from the start.

Defined cases: equal texts (empty ones too) are in one class; a null text is a class of its own; a text
without words is similar only to equal texts; a class is named by its smallest document id, nulls aside;
repeated rows are documents of one class. Of each class one row stays in ``distinct``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.llm import common
from hrefmill.llm.tables import fresh, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
# Texts, and bytes of text, in half a block; bytes of text that a task looks at together.
CHUNK, CHUNK_BYTES = 1024, 1_000_000
PIECE = 500_000
# Rows of an id, an MD5 and a number that may be broadcast: some 50 MB.
BROADCAST_ROWS = 500_000

_is_word = np.ones(256, bool)
_is_word[:0x80] = False
_is_word[0x30:0x3A] = _is_word[0x41:0x5B] = _is_word[0x61:0x7B] = True


def shingles(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted shingle sets of some texts: text number, shingle hash and count, ordered by hash."""
    starts, ends, first = common.words_in(data, off, _is_word)
    words = common.Prefix(data, common.byte_values(fold=True)).spans(starts, ends)
    sizes = np.diff(first)
    row = common.row_of(first)
    runs = common.chain(words, width)
    whole = np.arange(len(runs)) + width <= np.repeat(first[1:], sizes)[: len(runs)]
    parts, rows = [runs[whole]], [row[: len(runs)][whole]]
    for k in range(1, width):  # short texts
        short = np.flatnonzero(sizes == k)
        if len(short):
            parts.append(common.chain(words, k)[first[short]])
            rows.append(short)
    sh, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((row, sh)) if len(parts) > 1 else np.argsort(sh, kind="stable")
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], sh[at], np.diff(np.append(at, len(sh)))


def prob_min_hash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures of ``n`` weighted sets: for each register the element that arrived there first."""
    time = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, "u8")
    latest = np.full(n, np.inf)
    at = np.zeros(len(row))
    arrival = np.zeros(1, "u8")
    while len(row):
        arrival += np.uint64(1)
        draw = common.mix(element + arrival * np.uint64(0x9E3779B97F4A7C15))
        # The next gap of the Poisson process, and the register where the arrival falls.
        at = at - np.log(((draw >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53) / weight
        open_ = at < latest[row]
        row, element, weight, at, draw = (x[open_] for x in (row, element, weight, at, draw))
        slot = row * registers + (common.mix(draw) % np.uint64(registers)).astype("i8")
        np.minimum.at(time, slot, at)
        won = time[slot] == at
        holder[slot[won]] = element[won]
        latest = time.reshape(n, registers).max(axis=1)
    return holder.reshape(n, registers)


def _signature_task(bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, off in common.pieces(batch.column(2), PIECE):
                n = end - begin
                row, element, weight = shingles(data, off)
                some = np.bincount(row, minlength=n) > 0
                number = np.cumsum(some) - 1
                signature = prob_min_hash(number[row], element, weight, int(some.sum()), bands * rows)
                banded = signature.reshape(-1, bands, rows)
                keys = np.zeros(banded.shape[:2], "u8") + np.arange(bands, dtype="u8")
                for k in range(rows):
                    keys = common.mix(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k])
                offsets = np.concatenate([[0], np.cumsum(some * bands)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view("i8")))
                part = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["id", "key", "bands"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (elements ascending, counts).

    The sum over common elements d of 1 / sum over e of max(a(e) / a(d), b(e) / b(d)). With the elements ordered
    by a(e) / b(e), those at or above the ratio of d take the first term, those below it the second.
    """
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    below = np.searchsorted(ratio, ratio, "left")
    from_here = np.append(np.cumsum(x[::-1])[::-1], 0.0)[below]
    up_to = np.append(0.0, np.cumsum(y))[below]
    common_ = (x > 0) & (y > 0)
    return float((1.0 / (from_here[common_] / x[common_] + up_to[common_] / y[common_])).sum())


def _verify_task(least: float) -> Callable:
    """Keeps the pairs whose texts are similar."""

    def sets_of(column: pa.Array, begin: int, end: int) -> list[tuple[np.ndarray, np.ndarray]]:
        row, element, weight = shingles(*common.bytes_of(column.slice(begin, end - begin)))
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(end - begin + 1))
        return [(element[order[p:q]], weight[order[p:q]]) for p, q in zip(cuts[:-1], cuts[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, _, _ in common.pieces(batch.column(2), PIECE):
                left, right = sets_of(batch.column(2), begin, end), sets_of(batch.column(3), begin, end)
                linked = [similarity(a, b) >= least - 1e-9 for a, b in zip(left, right)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin)], ["a", "b"]
                ).filter(pa.array(linked))

    return run


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges (a, b)``: the smallest node each one is connected with."""
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        # The smallest label next door, then the label of that label.
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", "label", F.least("label", "near").alias("new")
        )
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = keep(
            step.join(jump, "new", "left").select("node", F.least("new", "far").alias("new"), F.col("label").alias("old"))
        )
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter(F.col("new") < F.col("old")).isEmpty():
            return labels


class _Classes:
    """Union-find over small class numbers."""

    def __init__(self, n: int):
        self.above = np.arange(n)

    def top(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def tops(self) -> np.ndarray:
        while True:
            higher = self.above[self.above]
            if (higher == self.above).all():
                return higher
            self.above = higher


def block_links(texts: pa.Array, classes_: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of classes to join, from all similar pairs of texts of different classes; at most one per class but one.

    Every text outside the block's largest class is held against all others: the postings lists of its shingles
    sum up the least shares of the common ones, which no probability Jaccard exceeds and which give it
    where no shingle is repeated. Only pairs whose sum suffices are looked at one by one.
    """
    row, element, weight = shingles(*common.bytes_of(texts))
    n = len(texts)
    mass = np.bincount(row, weights=weight, minlength=n)
    size = np.bincount(row, minlength=n)
    plain = mass == size  # no shingle repeated
    share = weight / mass[row]
    new = np.append(True, element[1:] != element[:-1]) if len(element) else np.zeros(0, bool)
    term = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(element))  # the postings of each shingle
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(n + 1))
    names, number = np.unique(classes_, return_inverse=True)
    joined, found = _Classes(len(names)), []
    largest = np.argmax(np.bincount(number))
    for x in np.flatnonzero(number != largest).tolist():
        mine = order[cuts[x] : cuts[x + 1]]
        if not len(mine):
            continue
        lists = list(zip(begin[term[mine]].tolist(), begin[term[mine] + 1].tolist()))
        others = np.concatenate([row[p:q] for p, q in lists])
        counted = np.bincount(others, minlength=n)
        most = counted / np.maximum(np.maximum(size, size[x]), 1)
        if not plain[x] or not plain[others].all():
            shares = np.concatenate([share[p:q] for p, q in lists])
            own = np.repeat(share[mine], [q - p for p, q in lists])
            most = np.bincount(others, weights=np.minimum(shares, own), minlength=n)
        likely = np.flatnonzero(most >= least - 1e-9)
        likely = likely[joined.tops()[number[likely]] != joined.top(number[x])]
        for y in likely.tolist():
            p, q = joined.top(number[x]), joined.top(number[y])
            if p == q:
                continue
            if plain[x] and plain[y]:
                similar = counted[y] >= least * (size[x] + size[y] - counted[y]) - 1e-9
            else:
                other = order[cuts[y] : cuts[y + 1]]
                similar = similarity((element[mine], weight[mine]), (element[other], weight[other])) >= least - 1e-9
            if similar:
                joined.above[q] = p
                found.append((int(names[number[x]]), int(names[number[y]])))
    return found


def _block_task(least: float) -> Callable:
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("node")
        links = block_links(block["text"].combine_chunks(), block["class"].to_numpy(), least)
        common.release()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _link_classes(
    members: DataFrame, texts: DataFrame, least: float, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``(node, class)`` for all nodes of ``members (bucket, node)``."""

    def mixed(rows: DataFrame) -> DataFrame:
        """Buckets with several classes, their smallest node and their size."""
        found = rows.groupBy("bucket").agg(
            F.min("class").alias("low"), F.max("class").alias("high"), F.min("node").alias("a"), F.count(F.lit(1)).alias("n")
        )
        return keep(found.filter(F.col("low") < F.col("high")).select("bucket", "a", "n"))

    def merged(links: DataFrame) -> DataFrame:
        found = components(links)
        return keep(found.filter(F.col("node") != F.col("label")).withColumnRenamed("node", "class"))

    def moved(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "class", "left").withColumn("class", F.coalesce("label", "class")).drop("label")

    active = members.withColumn("class", F.col("node"))
    # First every member against the first of its bucket.
    pairs = active.join(mixed(active), "bucket").filter(F.col("a") < F.col("node"))
    pairs = keep(pairs.select("a", F.col("node").alias("b")).distinct())
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    texted = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    labels = merged(keep(texted.mapInArrow(common.releasing(_verify_task(least)), "a long, b long")))
    active = keep(moved(active, labels))
    # Then all members of the buckets that still hold several classes, in blocks of bounded size.
    sizes = texts.select("node", F.octet_length("text").alias("size"))
    open_ = keep(active.join(mixed(active), "bucket").select("bucket", "node", "class", "n").join(sizes, "node"))
    bytes_in = open_.groupBy("bucket").agg(F.sum("size").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / chunk, F.col("bytes") / chunk_bytes)).cast("int")
    open_ = open_.join(bytes_in, "bucket").withColumn("chunks", F.greatest(parts, F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    blocks = open_.select(
        "bucket", "node", "class", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    rows = blocks.select(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "class"
    ).join(texts, "node")
    links = rows.groupBy("bucket", "low", "high").applyInArrow(_block_task(least), "a long, b long")
    labels = merged(keep(links.distinct()))
    return moved(active.select("node", "class").distinct(), labels)


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(id, key, class_id)`` for every row: the text's MD5 and the smallest id of its class."""
    named = docs.select(
        F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("key"), F.col(text_col).alias("text")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    signed = keep(named.mapInArrow(common.releasing(_signature_task(bands, rows)), f"id {kind}, key binary, bands array<long>"))
    # One node per text; its number is settled by the writing.
    nodes = keep(
        signed.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = shared.filter(F.col("low") < F.col("high")).select("bucket")
    members = keep(spread.join(shared, "bucket", "left_semi"))
    # The texts that have a candidate, each once.
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    wanted = keep(wanted.select(F.col("id").alias("first"), "key", "node"))
    if wanted.count() <= BROADCAST_ROWS:  # else the texts are shuffled to it
        wanted = F.broadcast(wanted)
    texts = keep(
        named.join(wanted, (named["key"] == wanted["key"]) & named["id"].eqNullSafe(wanted["first"]))
        .select("node", "text")
        .dropDuplicates(["node"])
    )
    linked = _link_classes(members, texts, least)
    whole = nodes.select("key", "id", "node").join(linked, "node", "left")
    whole = keep(whole.select("key", "id", F.coalesce("class", "node").alias("class")))
    names = keep(whole.groupBy("class").agg(F.min("id").alias("class_id")))
    by_key = keep(whole.join(names, "class").select("key", "class_id"))
    return signed.select("id", "key").join(by_key, "key", "left").withColumn("class_id", F.coalesce("class_id", "id"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each class, the one with the smallest id, with its columns as they were.

    Rows without an id stay unless their text has a copy with one.
    """
    key, rank = fresh("key", docs.columns), fresh("rank", docs.columns)
    found = classes(docs, id_col, text_col, **how)
    # Null texts are classes of their own: their rows go by without the join.
    first = found.filter(F.col("key").isNotNull() & F.col("id").eqNullSafe(F.col("class_id")))
    first = first.select(F.col("key").alias(key), F.col("id").alias(rank)).distinct()
    keyed = docs.withColumn(key, F.unhex(F.md5(F.col(text_col))))
    same = (keyed[key] == first[key]) & keyed[id_col].eqNullSafe(first[rank])
    kept = keyed.filter(keyed[key].isNotNull()).join(first, same).drop(first[key]).drop(rank)
    once = F.row_number().over(W.partitionBy(id_col, key).orderBy(F.lit(0)))
    kept = kept.withColumn(rank, once).filter(F.col(rank) == 1).drop(rank, key)
    return kept.unionByName(docs.filter(F.col(text_col).isNull()))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document; ``kept`` marks the one that stays of its class."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )
