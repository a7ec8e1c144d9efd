"""Benchmark decontamination: suffix arrays over the training texts, searched by every test suffix.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. Each shard of training
text (a run of documents inside a task, a few megabytes) gets a word-level suffix array by prefix
doubling. Every suffix of every benchmark item is then bisected in it, word by word, all suffixes at
once; the depth reached is its longest verbatim match in the shard, the final range holds the places.
Shards share nothing, so the scan shuffles nothing: a document's verdict is complete where it is read.

A window is ``window`` consecutive item words, or a whole item that is shorter but not empty. Matches
never cross documents. Defined cases: a null or empty text has no words and is never hit; a null or
wordless item matches nothing; an item without an id still hits words but is not counted in ``items``;
repeated documents are judged one by one, repeated item ids count once.

Test items travel to the tasks in blocks of at most ``BLOCK`` bytes of text, one scan stage a block, so
no task holds more than that many, whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK = 16_000_000
PIECE = 1_000_000  # bytes of text in one suffix array
NO_WORD = np.int64(-1)

_is_word = np.ones(256, bool)
_is_word[:0x80] = False
_is_word[0x30:0x3A] = _is_word[0x41:0x5B] = _is_word[0x61:0x7B] = True


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts and the number of the first word of each text."""
    starts, ends, first = common.words_in(data, off, _is_word)
    return common.Prefix(data, common.byte_values(fold=True)).spans(starts, ends), first


class SuffixArray(NamedTuple):
    """Suffixes of a shard in the order of their words' ids, exact down to ``depth`` words."""

    order: np.ndarray
    ids: np.ndarray
    ends: np.ndarray
    depth: int


def build(words: np.ndarray, first: np.ndarray, depth: int) -> SuffixArray:
    """Prefix doubling: sort by 1, 2, 4, ... words until ``depth`` is reached or no two suffixes tie.

    A word's id is the upper half of its hash; hits are verified on whole hashes afterwards.
    """
    n = len(words)
    ids = (words >> np.uint64(32)).astype("i8")
    ends = np.repeat(first[1:], np.diff(first))
    bits = max(1, n.bit_length())
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, "i8")

    def renumber(keys: np.ndarray) -> int:
        step = np.zeros(n, "i8")
        step[1:] = keys[1:] != keys[:-1]
        numbers = np.cumsum(step)
        rank[order] = numbers
        return int(numbers[-1]) + 1 if n else 0

    distinct = renumber(ids[order])
    reached = 1
    while reached < depth and distinct < n:
        follow = np.zeros(n, "i8")
        at = np.arange(n) + reached
        inside = at < ends
        follow[inside] = rank[at[inside]] + 1
        if 3 * bits + 1 <= 63:
            packed = np.sort((rank << (2 * bits + 1)) | (follow << bits) | np.arange(n))
            order = packed & ((1 << bits) - 1)
            distinct = renumber(packed >> bits)
        else:
            order = np.lexsort((follow, rank))
            distinct = renumber(rank[order] * (n + 1) + follow[order])
        reached *= 2
    return SuffixArray(order, ids, ends, depth if distinct == n else reached)


class Tests(NamedTuple):
    """All items of a block: words, the end of each word's item, its item's number, and ids."""

    words: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    first: np.ndarray
    names: list


def tests_of(texts: pa.Array, names: list) -> Tests:
    words, first = word_hashes(*common.bytes_of(texts))
    return Tests(words, np.repeat(first[1:], np.diff(first)), common.row_of(first), first, names)


def search(sa: SuffixArray, tests: Tests, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2, ... ``depth`` words: the test suffixes still matched, and their ranges in the array."""
    ids = (tests.words >> np.uint64(32)).astype("i8")
    in_order = sa.ids[sa.order]
    suffix = np.arange(len(ids))
    low, high = np.searchsorted(in_order, ids, "left"), np.searchsorted(in_order, ids, "right")
    for d in range(1, depth + 1):
        if d > 1:
            more = suffix + d - 1 < tests.ends[suffix]
            suffix, low, high = suffix[more], low[more], high[more]
            wanted = ids[suffix + d - 1]
            low, high = _bisect(sa, low, high, d - 1, wanted, False), _bisect(sa, low, high, d - 1, wanted, True)
        found = low < high
        suffix, low, high = suffix[found], low[found], high[found]
        if not len(suffix):
            return
        yield d, suffix, low, high


def _bisect(sa: SuffixArray, low: np.ndarray, high: np.ndarray, at: int, wanted: np.ndarray, right: bool) -> np.ndarray:
    """First place in each range whose word number ``at`` is not below (``right``: is above) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        place = sa.order[middle] + at
        inside = place < sa.ends[sa.order[middle]]
        word = np.where(inside, sa.ids[np.where(inside, place, 0)], NO_WORD)
        below = word <= wanted[open_] if right else word < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def occurrences(sa: SuffixArray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of all ranges, and for each the number of its range."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sa.order[low[which] + inside], which


def window_hits(words: np.ndarray, first: np.ndarray, tests: Tests, window: int) -> tuple[np.ndarray, ...]:
    """Places, lengths and item numbers of all occurrences of all windows in a shard."""
    if not len(words) or not len(tests.words):
        return tuple(np.zeros(0, "i8") for _ in range(3))
    sa = build(words, first, window)
    sizes = np.diff(tests.first)
    wanted = np.minimum(window, sizes)[tests.item]
    begins = np.arange(len(tests.words)) + wanted <= tests.ends
    found = []
    for d, suffix, low, high in search(sa, tests, window):
        full = begins[suffix] & (wanted[suffix] == d)
        if full.any():
            place, which = occurrences(sa, low[full], high[full])
            start = suffix[full][which]
            same = np.ones(len(place), bool)
            for k in range(d):  # the whole hashes
                same &= words[place + k] == tests.words[start + k]
            found.append((place[same], np.full(same.sum(), d), tests.item[start[same]]))
    if not found:
        return tuple(np.zeros(0, "i8") for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _spans(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal covered runs inside each document: document, start and end in words of the document."""
    inside = np.zeros(len(covered) + 1, bool)
    inside[:-1] = covered
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    heads = first[:-1][first[:-1] < first[1:]]
    begins[heads] = inside[heads]
    stops = inside[:-1].copy()
    stops[:-1] &= ~inside[1:-1]
    tails = first[1:][first[:-1] < first[1:]] - 1
    stops[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(first, start, "right") - 1
    return doc, start - first[doc], end - first[doc]


def _scan_task(names: dict[str, str], block, window: int) -> Callable:
    """Adds or extends the columns of ``names`` (words, spans, items) by what one block of tests finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = tests_of(pa.array([t for _, t in block.value], pa.string()), [i for i, _ in block.value])
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(names["text"]))
            for begin, end, data, off in common.pieces(texts, PIECE):
                words, first = word_hashes(data, off)
                place, length, item = window_hits(words, first, tests, window)
                step = np.zeros(len(words) + 1, "i8")
                np.add.at(step, place, 1)
                np.add.at(step, place + length, -1)
                spans: list[list] = [[] for _ in range(end - begin)]
                items: list[list] = [[] for _ in range(end - begin)]
                for d, s, e in zip(*(x.tolist() for x in _spans(np.cumsum(step)[:-1] > 0, first))):
                    spans[d].append({"start": s, "end": e})
                doc = np.searchsorted(first, place, "right") - 1
                for d, i in sorted(set(zip(doc.tolist(), item.tolist()))):
                    if tests.names[i] is not None:
                        items[d].append(tests.names[i])
                part = batch.slice(begin, end - begin)
                columns = dict(zip(part.schema.names, part.columns))
                if names["spans"] in columns:
                    spans = [a + b for a, b in zip(columns[names["spans"]].to_pylist(), spans)]
                    items = [a + b for a, b in zip(columns[names["items"]].to_pylist(), items)]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns[names["n"]] = pa.array(np.diff(first), pa.int64())
                columns[names["spans"]] = pa.array(spans, span)
                columns[names["items"]] = pa.array(items, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded bytes of text, read from the cluster one at a time."""
    block, size = [], 0
    items = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull())
    for name, text in items.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += len(text.encode()) + 32
    yield block


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """All rows and columns of ``docs`` plus word count, contaminated spans (in words) and ids of items.

    ``items`` may name an item once per block; overlapping spans of different blocks are not merged.
    """
    spark = docs.sparkSession
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = (T.LongType(), span, T.ArrayType(T.StringType()))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    used = {"text": text_col, "n": names[0], "spans": names[1], "items": names[2]}
    out = docs
    for part in _blocks(benchmark, item_col, item_text_col, block):
        out = out.mapInArrow(common.releasing(_scan_task(used, spark.sparkContext.broadcast(part), window)), schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: word count, words hit, items with windows in it, and the verdict."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **how)
    # Words in the union of the spans: each adds what lies beyond all that end before it.
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
    )
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        merged["n"].alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark window, with their columns as they were."""
    names = tuple(fresh(n, docs.columns) for n in ("n_words", "spans", "items"))
    found = scan(docs, benchmark, text_col=text_col, names=names, **how)
    return found.filter(F.size(names[1]) == 0).select(*docs.columns)


def _longest_task(block, depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = tests_of(pa.array([t for _, t in block.value], pa.string()), [i for i, _ in block.value])
        for batch in batches:
            for begin, end, data, off in common.pieces(batch.column(1), PIECE):
                words, first = word_hashes(data, off)
                if not len(words):
                    continue
                sa = build(words, first, depth)
                best, place = np.zeros(len(tests.words), "i8"), np.zeros(len(tests.words), "i8")
                for d, suffix, low, _ in search(sa, tests, depth):
                    best[suffix], place[suffix] = d, sa.order[low]
                hit = np.flatnonzero(best)
                doc = np.searchsorted(first, place[hit], "right") - 1
                ids = batch.column(0).slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tests.names[i] for i in tests.item[hit].tolist()], pa.string()),
                        pa.array(hit - tests.first[tests.item[hit]], pa.int64()),
                        pa.array(best[hit], pa.int64()),
                        ids.take(pa.array(doc)),
                        pa.array(place[hit] - first[doc], pa.int64()),
                    ],
                    ["item_id", "item_word", "length", "doc_id", "doc_word"],
                )

    return run


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """For each item suffix its longest verbatim match over all shards, with one place of it.

    Columns: item_id, item_word, length (words), doc_id (as string), doc_word. Ties take the smallest place.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "item_id string, item_word long, length long, doc_id string, doc_word long"
    found = []
    for part in _blocks(benchmark, "item_id", "text", block):
        depth = max([1, *(len(text) // 2 + 1 for _, text in part)])
        found.append(pairs.mapInArrow(_longest_task(spark.sparkContext.broadcast(part), depth), schema))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = F.struct("length", F.struct(F.lit(0)), "doc_id", "doc_word")
    return (
        every.groupBy("item_id", "item_word")
        .agg(F.max("length").alias("length"), F.min_by(order, -F.col("length")).alias("at"))
        .select("item_id", "item_word", "length", "at.doc_id", "at.doc_word")
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark, in the digest form of the contract."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return report(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def item_digest(items: list[str]) -> str:
    """The digest of a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS k FROM b WHERE len(w) BETWEEN 1 AND 9
    UNION SELECT DISTINCT item, 10, array_to_string(w[i:i+9], ' ')
    FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, p, n, array_to_string(w[p:p+n-1], ' ') AS k FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, p, n, item FROM dw JOIN bw USING (n, k)),
cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
    FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
