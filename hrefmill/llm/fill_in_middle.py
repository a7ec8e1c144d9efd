"""Fill-in-the-middle transformation with a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over buffers that never change: its own text
(buffer 0, in UTF-8 bytes) and one buffer per sentinel. Cutting splits descriptors, an arrangement permutes
them and puts sentinels between, and its inverse permutation restores the text; no step copies or edits text.
Digests stream over the descriptors. Only ``output``, where a caller asks for it, is ever put together, one
document at a time.

A document is cut into prefix, middle and suffix at two code points, both drawn from the hash of its seed and
id, so that a repeated or retried row is cut alike. Form ``psm`` writes prefix, suffix, middle; ``spm`` writes
suffix, prefix, middle; ``plain`` leaves the text as it is, for a drawn share of documents, for empty texts and
for texts that contain a sentinel, which could not be told from a real one.

Defined cases: a null text is an empty one; a null id hashes as an empty id; rows with one id draw the same
numbers, cut by their own length; prefix, middle and suffix may be empty; an empty table gives no rows; a
column of ``docs`` named like an output, in any case, is replaced by it.
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
from pyspark.sql import types as T

from hrefmill.llm import common

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = 0
SENTINELS = (b"<P>", b"<S>", b"<M>")
PREFIX, SUFFIX, MIDDLE = 1, 2, 3  # buffers of the sentinels, each before the part that it names
#: Order of the parts in each form, and which of the parts prefix, middle, suffix stands where.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_PART = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

_DESCRIPTOR = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
#: What ``transform`` can add, with its type in Spark and in Arrow.
KINDS = {
    "n": (T.LongType(), pa.int64()),
    "form": (T.StringType(), pa.string()),
    "prefix_chars": (T.LongType(), pa.int64()),
    "middle_chars": (T.LongType(), pa.int64()),
    "pieces": (
        T.ArrayType(
            T.StructType(
                [T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
            )
        ),
        pa.list_(_DESCRIPTOR),
    ),
    "output": (T.StringType(), pa.string()),
    "output_sha256": (T.StringType(), pa.string()),
    "restored_sha256": (T.StringType(), pa.string()),
}


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class Draw(NamedTuple):
    """Shares of a hundred, and the seed that the ids are hashed with."""

    seed: int = 1
    cut_percent: int = 90
    spm_percent: int = 20

    def numbers(self, doc_id: object) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


# --- the piece table ----------------------------------------------------------------------------


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """Split a list of descriptors after ``at`` bytes; at most one descriptor becomes two."""
    left: list[Piece] = []
    for k, piece in enumerate(pieces):
        if at < piece.length:
            if at:
                left.append(piece._replace(length=at))
            return left, [Piece(piece.buffer, piece.start + at, piece.length - at), *pieces[k + 1 :]]
        left.append(piece)
        at -= piece.length
    return left, []


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """Descriptors of the parts prefix, middle, suffix in the order of the form, each behind its sentinel."""
    out: list[Piece] = []
    for sentinel in ORDERS[form]:
        out.append(Piece(sentinel, 0, len(SENTINELS[sentinel - 1])))
        out.extend(parts[_PART[sentinel]])
    return out


def invert(pieces: list[Piece]) -> list[Piece]:
    """The inverse of ``arrange``: sentinels leave, parts go back to their places."""
    parts: list[list[Piece]] = [[], [], []]
    current = parts[0]  # a plain document has no sentinels and is in place
    for piece in pieces:
        if piece.buffer == TEXT:
            current.append(piece)
        else:
            current = parts[_PART[piece.buffer]]
    return [p for part in parts for p in part]


def parse(output: memoryview | bytes, form: str) -> list[Piece]:
    """Descriptors of a written document over its own bytes, found by its sentinels from left to right.

    The text has no sentinel, and a sentinel begins with its only ``<``, so none can arise where parts meet.
    """
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    raw = bytes(output)
    pieces: list[Piece] = []
    end = 0
    marks = [(s, SENTINELS[s - 1]) for s in ORDERS[form]]
    for k, (sentinel, mark) in enumerate(marks):
        if raw[end : end + len(mark)] != mark:
            raise ValueError(f"no {mark.decode()} where form {form} needs it")
        start = end + len(mark)
        end = raw.find(marks[k + 1][1], start) if k + 1 < len(marks) else len(raw)
        if end < 0:
            raise ValueError(f"no {marks[k + 1][1].decode()} in form {form}")
        pieces.append(Piece(sentinel, 0, len(mark)))
        pieces.append(Piece(TEXT, start, end - start))
    return pieces


def stream(pieces: list[Piece], text: memoryview) -> Iterator[memoryview]:
    """The bytes that descriptors stand for, buffer by buffer and without a copy."""
    for buffer, start, length in pieces:
        source = text if buffer == TEXT else memoryview(SENTINELS[buffer - 1])
        yield source[start : start + length]


def digest(pieces: list[Piece], text: memoryview) -> str:
    total = hashlib.sha256()
    for view in stream(pieces, text):
        total.update(view)
    return total.hexdigest()


# --- documents ----------------------------------------------------------------------------------


class Table(NamedTuple):
    """One document: its form, sizes in code points and descriptors in writing order."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[Piece]


def table_of(text: memoryview, heads: np.ndarray, doc_id: object, draw: Draw) -> Table:
    """Piece table of one text; ``heads`` are the bytes at which its code points begin."""
    n = len(heads)
    whole = [Piece(TEXT, 0, len(text))] if n else []
    h1, h2, h3, h4 = draw.numbers(doc_id)
    raw = bytes(text)
    if not n or any(mark in raw for mark in SENTINELS) or h3 % 100 >= draw.cut_percent:
        return Table(n, "plain", None, None, whole)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = lambda k: int(heads[k]) if k < n else len(text)
    head, suffix = cut(whole, at(second))
    prefix, middle = cut(head, at(first))
    form = "spm" if h4 % 100 < draw.spm_percent else "psm"
    return Table(n, form, first, second - first, arrange([prefix, middle, suffix], form))


def _value(name: str, table: Table, text: memoryview) -> object:
    if name in ("n", "form", "prefix_chars", "middle_chars"):
        return getattr(table, name)
    if name == "pieces":
        return [p._asdict() for p in table.pieces]
    if name == "output_sha256":
        return digest(table.pieces, text)
    written = b"".join(stream(table.pieces, text))
    if name == "output":
        return written.decode()
    # Restored from what was written and its form alone, as a reader of the output would.
    return digest(invert(parse(written, table.form)), memoryview(written))


def _task(text_at: int, id_at: int, kept: list[int], outputs: dict[str, str], draw: Draw) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in common.pieces(batch.column(text_at)):
                part = batch.slice(first, end - first)
                ids = part.column(id_at)
                # Every byte but a continuation byte begins a code point.
                heads = np.flatnonzero((data & 0xC0) != 0x80)
                bounds = np.searchsorted(heads, off)
                view = memoryview(np.ascontiguousarray(data))
                found: dict[str, list] = {name: [] for name in outputs}
                for r in range(end - first):
                    text = view[off[r] : off[r + 1]]
                    table = table_of(text, heads[bounds[r] : bounds[r + 1]] - off[r], ids[r].as_py(), draw)
                    for name, values in found.items():
                        values.append(_value(name, table, text))
                columns = [pa.array(values, KINDS[name][1]) for name, values in found.items()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), *columns], [*(part.schema.names[k] for k in kept), *outputs.values()]
                )

    return run


def transform(
    docs: DataFrame, outputs: dict[str, str], text_col: str = "text", id_col: str = "doc_id", draw: Draw = Draw()
) -> DataFrame:
    """``docs`` with columns of the transformation; ``outputs`` maps keys of ``KINDS`` to column names."""
    names = docs.columns
    new = {name.lower() for name in outputs.values()}
    kept = [k for k, name in enumerate(names) if name.lower() not in new]
    schema = T.StructType(
        [*(docs.schema.fields[k] for k in kept), *(T.StructField(name, KINDS[key][0]) for key, name in outputs.items())]
    )
    return docs.mapInArrow(_task(names.index(text_col), names.index(id_col), kept, outputs, draw), schema)


def restore(written: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """``written`` with the text that each document had before; a null output is an empty text.

    Raises where a document lacks the sentinels of its form.
    """
    names = written.columns
    output_at, form_at = names.index(output_col), names.index(form_col)
    kept = [k for k, name in enumerate(names) if name.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, off in common.pieces(batch.column(output_at)):
                part = batch.slice(first, end - first)
                forms = part.column(form_at)
                texts = []
                for r in range(end - first):
                    raw = data[off[r] : off[r + 1]].tobytes()
                    form = forms[r].as_py() or "plain"
                    texts.append(b"".join(stream(invert(parse(raw, form)), memoryview(raw))).decode())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in kept), common.strings(texts)], [*(names[k] for k in kept), text_col]
                )

    return written.mapInArrow(
        run, T.StructType([*(written.schema.fields[k] for k in kept), T.StructField(text_col, T.StringType())])
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, sizes and digests of every document, written and restored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keys = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return transform(docs, {key: key for key in keys}).drop("text")


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn
),
cuts AS (
  SELECT doc_id, t, n, least(a, b) AS i, greatest(a, b) AS j,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
),
parts AS (
  SELECT *, substring(t, 1, i) AS p, substring(t, i + 1, j - i) AS m, substring(t, j + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
