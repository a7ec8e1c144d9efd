"""Reading source files: listing, whole contents, and numbered lines of splittable text."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hrefmill.storage import cut_lineage

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Splits whose offsets are broadcast, some 100 bytes each; beyond that lines are joined to them.
BROADCAST_SPLITS = 200_000


def relative_name(path: Column, root: str) -> Column:
    """Path below ``root``; Spark reports paths as URIs, so escapes are undone."""
    tail = re.escape(root.rstrip("/").removeprefix("file:")) + "/(.*)$"
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_extract(plain, tail, 1)


def list_source_files(spark: SparkSession, root: str) -> DataFrame:
    """``filename, size, modified_at`` of all files below ``root``, newest first; contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = files.select(
        relative_name(F.col("_metadata.file_path"), root).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )
    return full.unionByName(_empty_files(spark, root, files, full)).orderBy(F.desc("modified_at"), "filename")


def _empty_files(spark: SparkSession, root: str, files: DataFrame, full: DataFrame) -> DataFrame:
    """Files of length 0, which Spark's readers skip, from the listing that Spark holds anyway."""
    names = spark.createDataFrame([(path,) for path in files.inputFiles()], "path string")
    empty = names.withColumn("filename", relative_name(F.col("path"), root)).join(full, "filename", "left_anti")
    rows, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for row in empty.collect():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(row["path"]))
        rows.append((row["filename"], 0, path.getFileSystem(conf).getFileStatus(path).getModificationTime()))
    made = spark.createDataFrame(rows, "filename string, size long, at long")
    return made.select("filename", "size", F.timestamp_millis("at").alias("modified_at"))


def read_source_files(spark: SparkSession, root: str) -> DataFrame:
    """``filename, content`` with one row per file, for files that fit in a row."""
    text = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    full = text.select(relative_name(F.col("_metadata.file_path"), root).alias("filename"), F.col("value").alias("content"))
    empty = list_source_files(spark, root).filter("size = 0").select("filename", F.lit("").alias("content"))
    return full.unionByName(empty)


def read_source_lines(spark: SparkSession, root: str) -> DataFrame:
    """``filename, pos, line`` with dense 0-based line numbers, for files of any size; as ``lines_of`` whole contents.

    Big files are read by many tasks. Inside a split lines arrive in order; the number of lines in
    the splits before it, one row per split, turns that into the line number within the file. The rows of splits are
    sent to the tasks, so that no text is shuffled. What a file's last line break leaves behind, and an empty
    file, is an empty line; the reader does not report those, so they follow from the length of the file.
    (The length of compressed text is unknown: there a last empty line is left out.)
    """
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("lineSep", "\n")
        .text(root)
        .select(
            relative_name(F.col("_metadata.file_path"), root).alias("filename"),
            F.col("_metadata.file_block_start").alias("__split"),
            F.col("_metadata.file_size").alias("__size"),
            F.monotonically_increasing_id().alias("__id"),
            F.col("value").alias("line"),
        )
    )
    splits = cut_lineage(
        raw.groupBy("filename", "__split").agg(
            F.min("__id").alias("__first"),
            F.count(F.lit(1)).alias("__n"),
            F.first("__size").alias("__size"),
            F.sum(F.octet_length("line") + 1).alias("__bytes"),
        )
    )
    before = W.partitionBy("filename").orderBy("__split").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select(
        "filename", "__split", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    if splits.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    numbered = raw.drop("__size").join(starts, ["filename", "__split"]).select(
        "filename", (F.col("__id") + F.col("__shift")).alias("pos"), "line"
    )
    whole = splits.groupBy("filename").agg(F.sum("__n").alias("pos"), F.sum("__bytes").alias("b"), F.first("__size").alias("size"))
    # Every line counts with a break; the last one has one if that is the length, a byte order mark (3) aside.
    ended = whole.filter((F.col("b") == F.col("size")) | (F.col("b") + 3 == F.col("size")))
    empty = list_source_files(spark, root).filter("size = 0").select("filename", F.lit(0).cast("bigint").alias("pos"))
    last = ended.select("filename", "pos").unionByName(empty).withColumn("line", F.lit(""))
    return numbered.unionByName(last)


def content_hashes(lines: DataFrame) -> DataFrame:
    """``filename, sha256`` of the content of each file, from its numbered lines.

    A hash reads a file from its start to its end, so the lines of a file pass through one task in their order;
    the task holds no more of it than the state of the hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for filename, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or filename != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = filename, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["filename", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, state.hexdigest())], ["filename", "sha256"])

    ordered = lines.select("filename", "pos", "line").repartition("filename").sortWithinPartitions("filename", "pos")
    return ordered.select("filename", "line").mapInArrow(run, "filename string, sha256 string")


def lines_of(files: DataFrame) -> DataFrame:
    """Numbered lines of a ``filename, content`` DataFrame; splits on ``\\n`` only."""
    return files.select("filename", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


def read_file_lines(lines: DataFrame, filename: str, start: int, count: int) -> DataFrame:
    """Lines ``[start, start + count)`` of one file, at most 500 as a page of a viewer."""
    if not 1 <= count <= 500:
        raise ValueError("count must be between 1 and 500")
    return lines.filter((F.col("filename") == filename) & F.col("pos").between(start, start + count - 1))


def total_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("filename").agg(F.count(F.lit(1)).alias("total_lines"))
