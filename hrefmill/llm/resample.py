"""Importance resampling towards a target distribution, over hashed runs of words with a head-tail vocabulary.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Features are all runs of
one to three neighbouring words, joined by one space; a feature's bucket is the CRC of its bytes modulo
``BUCKETS``. A bucket's gain is the logarithm of how much more often the target falls into it than the corpus
does; a document's weight is the sum of the gains of its features, and its score adds Gumbel noise drawn from
its id, so that taking the highest scores is a draw without replacement by weight.

Most features of a corpus are runs of a few common words. The ``HEAD_WORDS`` most frequent words, counted over
the whole corpus, travel to every task with the CRC each of them leaves behind, and the ``HEAD_PAIRS`` most
frequent pairs of them with their buckets. Every other word or run takes its CRC directly; CRCs of runs are
put together from those of their words, as appending bytes is a linear map. Head and tail give the same
number for the same bytes, so the bucket totals are exact whatever the head holds.

What is broadcast is bounded by parameters: ``HEAD_WORDS`` words of at most ``HEAD_BYTES`` bytes, ``HEAD_PAIRS``
pairs, ``BUCKETS`` gains. Tasks send one row per bucket and partition to the totals, so hot sources or words
make no group heavy.

Defined cases: a null text has no words; a document without words has weight 0; a null id hashes as an empty
one and comes last among equal scores; repeated rows are scored one by one; an empty corpus or target gives
gains of 0 features on that side; an empty table gives no rows; columns of ``docs`` named like a result, in
any case, are replaced by it.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import fresh, keep
from hrefmill.plans.ordering import with_global_position

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 2048, 64, 65_536
SEED, MIN_WORDS, PERCENT = 42, 20, 5

_is_word = np.ones(256, bool)
_is_word[:0x80] = False
_is_word[0x30:0x3A] = _is_word[0x41:0x5B] = _is_word[0x61:0x7B] = True
_folded = np.arange(256, dtype="u1")
_folded[0x41:0x5B] += 32


# --- CRC-32 of many byte strings at once ----------------------------------------------------------

# The reflected polynomial of CRC-32 is a fixed value; the table follows from it.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ _POLYNOMIAL, c >> np.uint32(1))
    return c


_step = _byte_table()


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _step[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _zeros_tables() -> tuple[np.ndarray, np.ndarray]:
    """What 0, 1, ... ``HEAD_BYTES`` zero bytes, and 1, 2, 4, ... of them, do to each byte of a register."""
    table = (np.arange(256, dtype="u4")[None, :] << (8 * np.arange(4, dtype="u4"))[:, None]).astype("u4")
    by_length = [table]
    for _ in range(HEAD_BYTES):
        by_length.append(_zero_byte(by_length[-1]))
    doubled = [by_length[1]]
    for _ in range(40):
        doubled.append(_through(doubled[-1], doubled[-1]))
    return np.stack(by_length), np.stack(doubled)


def _through(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (
        table[0][c & np.uint32(255)]
        ^ table[1][(c >> np.uint32(8)) & np.uint32(255)]
        ^ table[2][(c >> np.uint32(16)) & np.uint32(255)]
        ^ table[3][c >> np.uint32(24)]
    )


_by_length, _doubled = _zeros_tables()


def appended(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRC of each string after one more byte."""
    c = ~crc
    return ~(_step[(c ^ np.uint32(byte)) & np.uint32(255)] ^ (c >> np.uint32(8)))


def joined(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC of left + right, from the CRCs of both and the length of the right one."""
    short = np.minimum(right_bytes, HEAD_BYTES)
    moved = (
        _by_length[short, 0, left & np.uint32(255)]
        ^ _by_length[short, 1, (left >> np.uint32(8)) & np.uint32(255)]
        ^ _by_length[short, 2, (left >> np.uint32(16)) & np.uint32(255)]
        ^ _by_length[short, 3, left >> np.uint32(24)]
    )
    for k in np.flatnonzero(right_bytes > HEAD_BYTES):
        c, rest, bit = moved[k : k + 1], int(right_bytes[k]) - HEAD_BYTES, 0
        while rest >> bit:
            if rest >> bit & 1:
                c = _through(_doubled[bit], c)
            bit += 1
        moved[k] = c[0]
    return moved ^ right


def direct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC of each span: all spans step together byte by byte, long ones on their own."""
    sizes = ends - starts
    out = np.zeros(len(starts), "u4")
    for k in np.flatnonzero(sizes > HEAD_BYTES):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    order = np.flatnonzero(sizes <= HEAD_BYTES)
    order = order[np.argsort(-sizes[order], kind="stable")]
    if not len(order):
        return out
    at, longer = starts[order], -sizes[order]
    c = np.full(len(order), 0xFFFFFFFF, "u4")
    for k in range(int(-longer[0])):
        live = int(np.searchsorted(longer, -k, "left"))  # spans of more than k bytes
        c[:live] = _step[(c[:live] ^ data[at[:live] + k]) & np.uint32(255)] ^ (c[:live] >> np.uint32(8))
    out[order] = ~c
    return out


# --- the head ---------------------------------------------------------------------------------------


class Head(NamedTuple):
    """Frequent words by hash, with their bytes and CRCs, and the buckets of frequent pairs of them."""

    hashes: np.ndarray
    data: np.ndarray
    off: np.ndarray
    crc: np.ndarray
    pairs: np.ndarray  # first * len(hashes) + second, sorted
    pair_buckets: np.ndarray


def head_of(words: list[bytes]) -> Head:
    data = np.frombuffer(b"".join(words), "u1")
    off = np.cumsum([0, *map(len, words)]).astype("i8")
    hashes = common.Prefix(data, common.byte_values(fold=False)).spans(off[:-1], off[1:]) if words else np.zeros(0, "u8")
    # Of words with one hash the first is kept; the other takes its CRC directly.
    hashes, order = np.unique(hashes, return_index=True)
    kept = [words[k] for k in order]
    data = np.frombuffer(b"".join(kept), "u1")
    off = np.cumsum([0, *map(len, kept)]).astype("i8")
    none = np.zeros(0, "i8")
    return Head(hashes, data, off, direct(data, off[:-1], off[1:]), none, none)


def with_pairs(head: Head, pairs: np.ndarray, buckets: int = BUCKETS) -> Head:
    """The head with the buckets of some pairs of its words."""
    pairs = np.sort(pairs)
    a, b = np.divmod(pairs, max(1, len(head.hashes)))
    crc = joined(appended(head.crc[a], 0x20), head.crc[b], np.diff(head.off)[b])
    return head._replace(pairs=pairs, pair_buckets=(crc % np.uint32(buckets)).astype("i8"))


class Words(NamedTuple):
    """Words of a piece of texts: place, place in the head (-1: tail), CRC, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    head: np.ndarray
    crc: np.ndarray


def words_of(data: np.ndarray, off: np.ndarray, head: Head | None) -> tuple[np.ndarray, Words]:
    """Folded bytes and words of a piece; without a head neither head places nor CRCs."""
    low = _folded[data]
    starts, ends, first = common.words_in(data, off, _is_word)
    hashes = common.Prefix(low, common.byte_values(fold=False)).spans(starts, ends)
    if head is None:
        return low, Words(starts, ends, first, hashes, hashes, hashes)
    place = np.full(len(starts), -1, "i8")
    if len(head.hashes) and len(starts):
        at = np.minimum(np.searchsorted(head.hashes, hashes), len(head.hashes) - 1)
        sizes = ends - starts
        maybe = np.flatnonzero((head.hashes[at] == hashes) & (np.diff(head.off)[at] == sizes))
        # Equal hashes are no proof: the bytes are compared.
        long = sizes[maybe]
        inner = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        same = low[np.repeat(starts[maybe], long) + inner] == head.data[np.repeat(head.off[at[maybe]], long) + inner]
        differ = np.zeros(len(maybe) + 1, "i8")
        np.add.at(differ, np.repeat(np.arange(len(maybe)), long)[~same], 1)
        right = maybe[differ[:-1] == 0]
        place[right] = at[right]
    crc = np.zeros(len(starts), "u4")
    known = place >= 0
    crc[known] = head.crc[place[known]]
    tail = np.flatnonzero(~known)
    crc[tail] = direct(low, starts[tail], ends[tail])
    return low, Words(starts, ends, first, hashes, place, crc)


def buckets_of(data: np.ndarray, off: np.ndarray, head: Head, buckets: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for runs of one, two and three words the first word and the bucket of each run."""
    _, w = words_of(data, off, head)
    n = len(w.starts)
    word = np.arange(n)
    ends = np.repeat(w.first[1:], np.diff(w.first))
    sizes = w.ends - w.starts
    out = [(word, (w.crc % np.uint32(buckets)).astype("i8"))]

    two = word[word + 1 < ends]
    bucket = np.full(len(two), -1, "i8")
    both = np.flatnonzero((w.head[two] >= 0) & (w.head[two + 1] >= 0))
    if len(both) and len(head.pairs):
        key = w.head[two[both]] * len(head.hashes) + w.head[two[both] + 1]
        at = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
        hit = head.pairs[at] == key
        bucket[both[hit]] = head.pair_buckets[at[hit]]
    three = word[word + 2 < ends]
    # CRCs of pairs outside the head, and of those that a third word goes on from.
    need = np.zeros(n, bool)
    need[two[bucket < 0]] = True
    need[three] = True
    place = np.flatnonzero(need)
    crc = np.zeros(n, "u4")
    crc[place] = joined(appended(w.crc[place], 0x20), w.crc[place + 1], sizes[place + 1])
    rest = bucket < 0
    bucket[rest] = crc[two[rest]] % np.uint32(buckets)
    out.append((two, bucket))
    run = joined(appended(crc[three], 0x20), w.crc[three + 2], sizes[three + 2])
    out.append((three, (run % np.uint32(buckets)).astype("i8")))
    return w, out


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each piece that are short enough for the head, with how often they occur."""
    for batch in batches:
        for _, _, data, off in common.pieces(batch.column(0)):
            low, w = words_of(data, off, None)
            short = np.flatnonzero(w.ends - w.starts <= HEAD_BYTES)
            _, at, count = np.unique(w.hashes[short], return_index=True, return_counts=True)
            at = short[at]
            words = [low[a:b].tobytes() for a, b in zip(w.starts[at], w.ends[at])]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(count, pa.int64())], ["word", "n"])


def _counted_pairs(head) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        size = len(known.hashes)
        total = np.zeros(size * size, "u4")  # HEAD_WORDS squared, whatever the partition holds
        for batch in batches:
            for _, _, data, off in common.pieces(batch.column(0)):
                _, w = words_of(data, off, known)
                word = np.arange(len(w.starts))
                two = word[word + 1 < np.repeat(w.first[1:], np.diff(w.first))]
                two = two[(w.head[two] >= 0) & (w.head[two + 1] >= 0)]
                key, count = np.unique(w.head[two] * size + w.head[two + 1], return_counts=True)
                total[key] += count.astype("u4")
        key = np.flatnonzero(total)
        for k in range(0, len(key), 1 << 18):
            some = key[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype("i8"), pa.int64())], ["pair", "n"])

    return run


def _most_frequent(counted: DataFrame, key: str, most: int) -> list:
    """Values of ``key`` above a count that at most ``most`` of them reach, in order.

    The count is found from a histogram in steps of a twelfth power of two, so that no task ranks them.
    """
    counted = keep(counted)
    step = F.floor(12 * F.log2("n")).cast("int")
    sizes = sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True)  # some hundred rows
    lowest, total = None, 0
    for at, size in sizes:
        total += size
        if total > most:
            break
        lowest = at
    if lowest is None:
        return []
    return sorted(r[key] for r in counted.filter(step >= lowest).select(key).collect())


def vocabulary(
    texts: DataFrame, buckets: int = BUCKETS, head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS
) -> Head:
    """The head of a one-column table of texts: its most frequent words and pairs of them."""
    counted = texts.mapInArrow(_counted_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(w) for w in _most_frequent(counted, "word", head_words)]
    head = head_of(words)
    if not words:
        return head
    sent = texts.sparkSession.sparkContext.broadcast(head)
    pairs = texts.mapInArrow(_counted_pairs(sent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return with_pairs(head, np.array(_most_frequent(pairs, "pair", head_pairs), "i8"), buckets)


# --- totals, gains and weights ------------------------------------------------------------------------


def totals(texts: DataFrame, head, buckets: int = BUCKETS) -> np.ndarray:
    """Exact number of features of a one-column table of texts in each bucket; ``head`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, "i8")
        for batch in batches:
            for _, _, data, off in common.pieces(batch.column(0)):
                for _, bucket in buckets_of(data, off, head.value, buckets)[1]:
                    found += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(found[hit], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, "i8")
    summed = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both shares in each bucket, one added to every count, rounded down."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    ratios = ((float(t) + 1) * s_all / ((float(s) + 1) * t_all) for s, t in zip(corpus, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], "i8")


def _weight_task(text_at: int, kept: list[int], names: list[str], head, gains, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in common.pieces(batch.column(text_at)):
                part = batch.slice(first, end - first)
                w, runs = buckets_of(data, off, head.value, buckets)
                weight, count = np.zeros(end - first, "i8"), np.zeros(end - first, "i8")
                for word, bucket in runs:
                    cuts = np.searchsorted(word, w.first)
                    sums = np.concatenate([[0], np.cumsum(gains.value[bucket])])
                    weight += sums[cuts[1:]] - sums[cuts[:-1]]
                    count += np.diff(cuts)
                found = [np.diff(w.first), count, weight]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), *(pa.array(v, pa.int64()) for v in found)],
                    [*(part.schema.names[k] for k in kept), *names],
                )

    return run


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, its likeness to ``target`` against all of ``docs``."""
    sc = docs.sparkSession.sparkContext
    corpus, wanted = docs.select(F.col(text_col)), target.select(F.col(target_col))
    head = sc.broadcast(vocabulary(corpus, buckets))
    gains = sc.broadcast(gains_of(totals(corpus, head, buckets), totals(wanted, head, buckets)))
    names = ["n_words", "n_features", "weight"]
    kept = [k for k, name in enumerate(docs.columns) if name.lower() not in names]
    schema = T.StructType([*(docs.schema.fields[k] for k in kept), *(T.StructField(n, T.LongType()) for n in names)])
    return docs.mapInArrow(_weight_task(docs.columns.index(text_col), kept, names, head, gains, buckets), schema)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the hash of seed and id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(
    weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """``weighed`` rows with ``score`` and the ``rank`` of the drawn ones, the highest ``percent`` of a hundred.

    Documents of fewer than ``min_words`` words are not drawn from. Give it narrow rows: they are written
    once, then sorted by range over all tasks.
    """
    plain = weighed.drop(*[c for c in weighed.columns if c.lower() in ("score", "rank")])
    scored = keep(plain.withColumn("score", F.col("weight") + noise(id_col, seed)))
    long_enough = F.col("n_words") >= min_words
    able = scored.filter(long_enough)
    wanted = able.count() * percent // 100
    lower, no_id, at = (fresh(f"__{n}", scored.columns) for n in ("lower", "no_id", "at"))
    keyed = able.withColumns({lower: -F.col("score"), no_id: F.col(id_col).isNull()})
    placed = with_global_position(keyed, [lower, no_id, id_col], at)
    rank = F.when(F.col(at) < wanted, F.col(at) + 1).cast("bigint")
    ranked = placed.withColumn("rank", rank).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; rows of one id and text are drawn alike."""
    weighed = weigh(docs, target, text_col, target_col)
    drawn = draw(weighed, id_col, percent)
    return drawn.filter(F.col("rank").isNotNull()).select(*docs.columns)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    weighed = weigh(docs, target).drop("text")
    return draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS v, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
),
crc AS (SELECT list(c ORDER BY v) AS step FROM bits WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
),
cut AS (
  SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts
),
runs AS (
  SELECT side, rid, unnest(list_concat(list_concat(w,
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM cut
),
counted AS (SELECT side, rid, f, count(*) AS n FROM runs GROUP BY side, rid, f),
names AS (SELECT DISTINCT f FROM counted),
hexed AS (SELECT f, hex(encode(f)) AS x FROM names),
hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(x) // 2), lambda i:
              CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
            lambda c, b: xor(c // 256, step[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc
),
placed AS (SELECT side, rid, bucket, n FROM counted JOIN hashed USING (f)),
totals AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 't' THEN n ELSE 0 END) AS t FROM placed GROUP BY bucket
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + 10000)::DOUBLE)
                                      / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM totals
),
weights AS (SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut LEFT JOIN weights USING (rid) WHERE side = 'd'
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * able // 100 THEN r END AS rank FROM ranked
"""
