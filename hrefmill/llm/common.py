"""Text batches as NumPy arrays, and hashes, for the tasks of the training-data operators.

Python work here runs inside ``mapInArrow`` tasks. A record batch is cut into pieces of a few megabytes
of text, a piece is one byte array with offsets, and every step below is a NumPy pass over it, so memory
per task stays small whatever the batch size; only a single text longer than a piece is taken whole.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 2_000_000


# --- text batches -------------------------------------------------------------------------------


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, "u1"), np.zeros(n + 1, "i8")
    kind = np.dtype("i8" if wide else "i4")
    off = np.frombuffer(offsets, kind, n + 1, column.offset * kind.itemsize).astype("i8")
    return np.frombuffer(data, "u1")[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows: (first row, end row, bytes, offsets from 0)."""
    data, off = bytes_of(column)
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def release() -> None:
    """Forget what this process keeps between pieces, and give freed memory back where the C library can."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def releasing(task: Callable) -> Callable:
    """``task``, after which its worker holds no more than before: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def words_in(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of word bytes inside a row, and each row's first word.

    ``is_word`` has one truth value per byte value. The third array has one entry more than rows.
    """
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    tails = off[1:][off[:-1] < off[1:]] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


# --- hashes -------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class _Local(dict):
    """Values of one process; they do not travel with the task code."""

    def __reduce__(self):
        return _Local, ()


_powers: dict[str, np.ndarray] = _Local()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold: bool) -> np.ndarray:
    """A scrambled 64-bit value per byte value; with ``fold`` A-Z get the values of a-z."""
    codes = np.arange(256, dtype="u8")
    if fold:
        codes[65:91] += np.uint64(32)
    return mix(codes + np.uint64(0x1234567))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown on demand and kept per worker."""
    if len(_powers.get("up", ())) < n:
        size = 1 << (n - 1).bit_length()  # a few growths at most, and no more than the pieces need
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Prefix:
    """Polynomial prefix sums over bytes: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scrambled hash of each span, its length included."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype("u8") * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, width: int) -> np.ndarray:
        """Scrambled hash of the span of ``width`` at each place, as ``spans`` gives it."""
        raw = self.sums[width:] - self.sums[:-width]
        raw *= self.down[: len(raw)]
        raw += np.uint64(width * 0xD6E8FEB86659FD93 & _MASK)
        return mix(raw)


def chain(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours in ``h`` (length ``len(h) - width + 1``)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, "u8")
    out = np.zeros(n, "u8")
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


def row_of(off: np.ndarray) -> np.ndarray:
    """Row number of each element, from offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def strings(values: np.ndarray | list) -> pa.Array:
    return pa.array(values, pa.string())
