"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``width`` bytes of a suffix (its window) matter: two windows that are equal after all
digits are exactly a repeated string. The sort goes by most significant digits, one Spark pass a digit
of ``DIGITS``, and each pass drops or settles groups, so that ever fewer suffixes go on. The digit of a
window at a pass is its anchor: of its strings of so many bytes the one with the smallest hash, the leftmost
of equal ones. It depends on the window's bytes alone, so equal windows agree on it, and neighbouring windows
mostly share one, so a run of windows is one row (about one per 16 bytes of text at the first pass). The
last digit is as wide as the window and a run is a single window. At each pass

* a group (equal anchors) whose rows come from one document ends: nothing in it repeats;
* a group with one run string is settled: every document but the first loses the run's windows;
* in any other group, a run string loses its windows in every document but the first that has it, and the
  first one's windows go on to the next pass.

A window's first document is never settled away from it, so the verdict of the last pass is exact. The rows of
the first pass are made twice: for the groups, and again for the groups that repeat. The second time a bit map
of the repeated anchors, of at most ``MOST_BITS``, drops most other rows before they are shuffled; it has no
misses, so it changes no result, and where it fills up the join alone decides. Groups are told apart by two independent 64-bit hashes, of anchor and run. Groups are summed up in the map tasks
before any shuffle, so a string in a third of all rows is one row per task. All judgements are on the input.

Defined cases: a null text is empty; texts shorter than ``width`` keep everything; rows with the same id
never remove from each other; a row without an id neither removes nor loses anything; an empty table
gives no rows. Bytes are removed as such, so what is left of a text may be invalid UTF-8.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hrefmill.llm import common
from hrefmill.llm.tables import drop, fresh_folder, keep, publish

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 50
DIGITS = (20, 36, 50)
#: The bit map of repeated anchors has eight to sixteen bits an anchor, and never more than this (32 MB).
MOST_BITS = 1 << 28
_BLOCK = 32768  # bits of one bitmap_construct_agg
_LOW = np.uint64(0xFFFFFFFF)


def inside(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in any of the spans."""
    step = np.zeros(size + 1, "i4")
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:-1] > 0


class Runs:
    """Runs of windows with a common anchor in some texts: first and last window start, and two hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int, digit: int):
        self.first = self.last = np.zeros(0, "i8")
        self.anchor = self.string = np.zeros(0, "u8")
        n = len(data)
        if n < width:
            return
        grams = common.Prefix(data, common.byte_values(fold=False)).grams(digit)
        # Smallest hash (upper half), leftmost of equal ones (place in the lower half), over each window.
        low = grams & ~_LOW
        low |= np.arange(len(grams), dtype="u8")
        reach, want = 1, width - digit + 1
        while reach < want:
            step = min(reach, want - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        at = (low & _LOW).astype("i8")
        # Not the windows that would leave their text.
        chosen = ~inside(n, np.maximum(off[:-1], off[1:] - width + 1), off[1:])[: len(at)]
        change = np.ones(len(at) + 1, bool)
        change[1:-1] = (at[1:] != at[:-1]) | (chosen[1:] != chosen[:-1])
        self.first = np.flatnonzero(change[:-1] & chosen)
        self.last = np.flatnonzero(change[1:] & chosen)
        self.anchor = grams[at[self.first]]
        values = common.mix(common.byte_values(fold=False) + np.uint64(0x5BD1E995))
        self.string = common.Prefix(data, values).spans(self.first, self.last + width)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view("i8"), pa.int64())


def _spans_of(lists: pa.Array, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in the bytes of a piece, from each text's list of ``start << 32 | end``."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    packed = lists.flatten().to_numpy()
    shift = np.repeat(off[:-1], counts)
    return (packed >> 32) + shift, (packed & 0xFFFFFFFF) + shift


def _alive_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The bytes of the windows that start in any of the spans, as parts: bytes, offsets, each part's place in ``data``.

    Spans that touch are one part, so neighbouring windows stay neighbours; spans lie in one text each, and so do the parts.
    """
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > ends[:-1]
    heads = np.flatnonzero(fresh)
    at = starts[heads]
    sizes = ends[np.append(heads[1:], len(starts)) - 1] + (width - 1) - at if len(heads) else np.zeros(0, "i8")
    off = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(at - off[:-1], sizes) + np.arange(off[-1])], off, at


def _set_bits(name: str) -> np.ndarray:
    """The published bit map, mapped from the executor's file."""
    return np.memmap(SparkFiles.get(name), "u1", "r")


def _run_task(width: int, digit: int, spans: bool, bits: str | None = None) -> Callable:
    """Runs of each text: (id, anchor, string) and, with ``spans``, (start, last) windows in the text.

    A third input column lists the spans of windows still alive. With ``bits`` only anchors in that bit map come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if bits is None else _set_bits(bits)
        for batch in batches:
            for begin, end, data, off in common.pieces(batch.column(1)):
                if batch.num_columns > 2:
                    alive = _spans_of(batch.column(2).slice(begin, end - begin), off)
                    part, part_off, at = _alive_parts(data, *alive, width)
                    runs = Runs(part, part_off, width, digit)
                    shift = (at - part_off[:-1])[np.searchsorted(part_off, runs.first, "right") - 1]
                else:
                    runs, shift = Runs(data, off, width, digit), 0
                first, last, anchor, string = runs.first + shift, runs.last + shift, runs.anchor, runs.string
                if wanted is not None:
                    bit = anchor & np.uint64(8 * len(wanted) - 1)
                    hit = np.flatnonzero(wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype("u1") & 1)
                    first, last, anchor, string = first[hit], last[hit], anchor[hit], string[hit]
                row = np.searchsorted(off, first, "right") - 1
                ids = batch.column(0).slice(begin, end - begin).take(pa.array(row))
                columns = {"id": ids, "anchor": _signed(anchor), "string": _signed(string)}
                if spans:
                    columns["start"] = pa.array(first - off[row], pa.int64())
                    columns["last"] = pa.array(last - off[row], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def anchor_bits(shared: DataFrame, most: int = MOST_BITS) -> str:
    """Publish a bit map of the anchors, by their low bits (an anchor's high bits are small: it is a smallest hash).

    It has a power of two of bits, at most ``most``, and at least one block of 32,768.
    """
    size = max(_BLOCK, min(most, 1 << (8 * shared.count()).bit_length()))
    place = F.col("anchor").bitwiseAND(F.lit(size - 1)) + 1
    blocks = shared.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray(size // 8)
    for block, bits in blocks.collect():  # at most ``most`` bits
        out[(block - 1) * len(bits) : block * len(bits)] = bits
    return publish(shared.sparkSession, "anchors", bytes(out))


def shares_ids(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether some id has different texts."""
    hashes = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).groupBy("id")
    return not hashes.agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low < high").isEmpty()


def identity(plain: bool, id_col: str, text_col: str) -> Column:
    """What a document is known by: its id, or its id and its text's hash."""
    return F.col(id_col) if plain else F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    digits: tuple[int, ...] = DIGITS,
    plain: bool | None = None,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``(id, start, last)``: runs of windows that also start in a document with a smaller id.

    ``id`` is the ``identity`` of the document. The last digit must be ``width``. The runs' bytes cover exactly what is to be removed.
    ``plain`` says that no id has different texts; where it is not given, this is looked up.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.octet_length("text") >= width)
    )
    # Where an id has several texts, the text's hash goes with the id; only the id is compared.
    plain = not shares_ids(docs, id_col, text_col) if plain is None else plain
    own = (lambda c: F.col(c)) if plain else (lambda c: F.col(c)["id"])
    texts = texts.withColumn("id", identity(plain, "id", "text"))
    kind = texts.schema["id"].dataType.simpleString()
    brief = f"id {kind}, anchor long, string long"
    spark = docs.sparkSession
    found = []
    for level, digit in enumerate(digits):
        # Tables of this pass that go as soon as the next one is written.
        passing = [f"{fresh_folder(spark)}/{name}" for name in ("runs", "shared", "strings")]
        if level:
            runs = keep(texts.mapInArrow(_run_task(width, digit, True), f"{brief}, start long, last long"), passing[0])
            rows = runs
        else:  # cheaper made twice than stored
            rows = texts.mapInArrow(_run_task(width, digit, False), brief)
        groups = rows.groupBy("anchor").agg(
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
            F.min("string").alias("low"),
            F.max("string").alias("high"),
        )
        repeated = groups.filter(own("first_id") < own("last_id"))
        # Kept, so that the shuffle files of the groups are gone before those of the join come.
        shared = keep(
            repeated.select("anchor", "first_id", (F.col("low") == F.col("high")).alias("settled")), passing[1]
        )
        if not level:
            task = _run_task(width, digit, True, anchor_bits(shared, most_bits))
            runs = texts.mapInArrow(task, f"{brief}, start long, last long")
        open_ = [F.when(~F.col("settled"), F.col(c)).alias(c) for c in ("anchor", "string")]  # of no use once settled
        met = keep(
            runs.join(shared, "anchor")
            .filter(~F.col("settled") | (own("id") > own("first_id")))
            .select("id", *open_, "settled", "start", "last")
        )
        drop(spark, *passing[:2])
        found.append(met.filter("settled").select("id", "start", "last"))
        left = met.filter(~F.col("settled"))
        # Kept, so that the join has plain shuffles on both sides and a hot string's rows can be split.
        strings = keep(left.groupBy("anchor", "string").agg(F.min("id").alias("first_id")), passing[2])
        told = keep(left.join(strings, ["anchor", "string"]).select("id", "first_id", "start", "last"))
        drop(spark, passing[2])
        found.append(told.filter(own("id") > own("first_id")).select("id", "start", "last"))
        alive = told.filter(own("id") == own("first_id"))
        packed = F.shiftleft("start", 32).bitwiseOR(F.col("last") + 1)
        lists = alive.groupBy("id").agg(F.collect_list(packed).alias("alive"))
        texts = texts.select("id", "text").join(lists, "id")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut_task(outputs: dict[str, str], text: str, spans: str) -> Callable:
    """Adds the kept bytes and counts; ``spans`` holds ``start << 32 | end`` numbers and is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(spans)
            rest = [i for i in range(batch.num_columns) if i != at]
            for begin, end, data, off in common.pieces(batch.column(batch.schema.get_field_index(text))):
                gone = inside(len(data), *_spans_of(batch.column(at).slice(begin, end - begin), off))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = off[:-1][off[:-1] < off[1:]]
                begins[heads] = gone[heads]
                kept = data[~gone]
                sizes, removed = np.diff(off), np.diff(np.concatenate([[0], np.cumsum(gone)])[off])
                ends = np.concatenate([[0], np.cumsum(sizes - removed)])
                pairs = zip(ends[:-1].tolist(), ends[1:].tolist())
                made = {
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(np.diff(np.concatenate([[0], np.cumsum(begins)])[off]), pa.int64()),
                }
                if "kept_sha256" in outputs:
                    made["kept_sha256"] = common.strings([hashlib.sha256(kept[a:b].data).hexdigest() for a, b in pairs])
                elif "kept" in outputs:
                    made["kept"] = pa.array([kept[a:b].tobytes() for a, b in pairs], pa.binary())
                part = batch.slice(begin, end - begin)
                columns = {part.schema.names[i]: part.column(i) for i in rest}
                columns |= {name: made[key] for key, name in outputs.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_KINDS = {
    "n_bytes": T.LongType(),
    "n_removed": T.LongType(),
    "n_spans": T.LongType(),
    "kept": T.BinaryType(),
    "kept_sha256": T.StringType(),
}


def dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept"),
    width: int = WIDTH,
    digits: tuple[int, ...] = DIGITS,
) -> DataFrame:
    """``(doc_id, text)`` plus ``outputs``: what is left of each text (``kept``, bytes; or its digest) and counts."""
    plain = not shares_ids(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, width, digits, plain)
    packed = F.shiftleft("start", 32).bitwiseOR(F.col("last") + width)
    lists = keep(spans.groupBy("id").agg(F.collect_list(packed).alias("__spans")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known_by = identity(plain, "doc_id", "text")
    joined = rows.withColumn("__by", known_by).join(lists.withColumnRenamed("id", "__by"), "__by", "left").drop("__by")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(o, _KINDS[o]) for o in outputs)])
    return joined.mapInArrow(_cut_task({o: o for o in outputs}, "text", "__spans"), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from all documents, in the digest form of the contract."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256")).drop("text")
