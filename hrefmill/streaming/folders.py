"""Folders of micro-batches, merged in tiers so that a stream of any length leaves few of them.

A batch writes ``batch=n``. Once ``FANOUT`` folders of done batches lie side by side they become one folder
``merged=a-b`` whose rows carry their batch as a column, ``FANOUT`` of those become a larger one, and so on: a row is
written again as often as the logarithm of the number of batches. A small file names the merged folders that are
valid; it is written under a new number only when the folders are complete, so a reader sees either the old
folders or the new one, and a merge that fails half-way changes nothing. Folders that a merge has replaced
stay until the next merge, for readers that have begun.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"
FANOUT = 8
_LIST = "_merged"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _merged(spark: SparkSession, table: str) -> tuple[int, list[tuple[int, int]]]:
    """Number of the newest list, and the ranges of batches whose merged folders are valid."""
    numbers = [int(n) for n in _names(spark, f"{table}/{_LIST}") if n.isdigit()]
    if not numbers:
        return 0, []
    newest = max(numbers)
    rows = spark.read.text(f"{table}/{_LIST}/{newest}").collect()  # FANOUT lines a tier
    return newest, sorted(tuple(int(x) for x in r["value"].split("-")) for r in rows if r["value"])


def folders(spark: SparkSession, table: str) -> tuple[list[tuple[int, int]], list[int]]:
    """The merged ranges and the single batches that make up the table now."""
    ranges = _merged(spark, table)[1]
    done = max((b for _, b in ranges), default=-1)
    single = [int(n.split("=")[1]) for n in _names(spark, table) if n.startswith(f"{BATCH}=")]
    return ranges, sorted(n for n in single if n > done)


def _write(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows sorted by ``order``, whose first column makes folders."""
    if order:
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(order[0]).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_batch(df: DataFrame, table: str, batch_id: int, order: list[str] = ()) -> None:
    _write(df, f"{table}/{BATCH}={batch_id}", order)


def _level(low: int, high: int, fanout: int) -> int:
    return int(math.log(high - low + 1, fanout) + 1e-9)


def _read(spark: SparkSession, table: str, ranges: list[tuple[int, int]], single: list[int]) -> DataFrame | None:
    parts = []
    if ranges:
        parts.append(spark.read.parquet(*[f"{table}/merged={a}-{b}" for a, b in ranges]))
    if single:
        plain = spark.read.option("basePath", table).parquet(*[f"{table}/{BATCH}={n}" for n in single])
        parts.append(plain.withColumn(BATCH, F.col(BATCH).cast("bigint")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_batches(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """All rows written so far, with their batch; only batches before one when given."""
    ranges, single = folders(spark, table)
    if before is not None:
        ranges, single = [r for r in ranges if r[0] < before], [n for n in single if n < before]
    found = _read(spark, table, ranges, single)
    if found is None or before is None or all(b < before for _, b in ranges):
        return found
    return found.filter(F.col(BATCH) < before)


def merge_folders(
    spark: SparkSession,
    table: str,
    batch_id: int,
    fold: Callable[[DataFrame], DataFrame] | None = None,
    order: list[str] = (),
    fanout: int = FANOUT,
) -> None:
    """Merge folders of batches before ``batch_id``, which are done and will not run again.

    ``fold`` may reduce the rows of merged batches (to the newest of each key, say); ``order``
    names columns by which merged rows lie sorted, the first one as folders. Call it from the sink of batch ``batch_id``, after its write.
    """
    ranges, single = folders(spark, table)
    single = [n for n in single if n < batch_id]
    if len(single) < fanout:
        return
    kept, low, high = list(ranges), ranges[-1][1] + 1 if ranges else single[0], single[-1]
    while True:
        level = _level(low, high, fanout)
        tail = list(itertools.takewhile(lambda r: _level(*r, fanout) <= level, reversed(kept)))
        if len(tail) + 1 < fanout:
            break
        kept, low = kept[: -len(tail)], tail[-1][0]
    rows = _read(spark, table, [r for r in ranges if r not in kept], single)
    _write(rows if fold is None else fold(rows), f"{table}/merged={low}-{high}", order)
    newest, _ = _merged(spark, table)
    fs, path = _fs(spark, f"{table}/{_LIST}/{newest + 1}")
    out = fs.create(path, True)
    out.write("\n".join(f"{a}-{b}" for a, b in [*kept, (low, high)]).encode())
    out.close()
    _drop_replaced(spark, table, newest)


def _drop_replaced(spark: SparkSession, table: str, before: int) -> None:
    """Folders that neither the list before the newest one nor a later batch needs."""
    if not before:
        return
    fs, old = _fs(spark, f"{table}/{_LIST}/{before}")
    was = [r["value"] for r in spark.read.text(old.toString()).collect() if r["value"]]
    now = [f"{a}-{b}" for a, b in _merged(spark, table)[1]]
    done = max(int(v.split("-")[1]) for v in was)
    for name in _names(spark, table):
        kind, _, value = name.partition("=")
        if (kind == "merged" and value not in was + now) or (kind == BATCH and int(value) <= done):
            fs.delete(_fs(spark, f"{table}/{name}")[1], True)
    for name in _names(spark, f"{table}/{_LIST}"):
        if name.isdigit() and int(name) < before:
            fs.delete(_fs(spark, f"{table}/{_LIST}/{name}")[1], True)
