"""Continuous import, deduplication and counts over file streams.

Every sink writes the rows of one micro-batch to its own folder, named by the batch, in overwrite
mode. A batch that runs again after a failure therefore replaces its rows and never doubles them;
Spark's checkpoint remembers which files are done. Folders of batches that are done are merged now and then
(``hrefmill.streaming.folders``), so their number stays small however long a stream runs.

What a batch must know of earlier ones does not cost a read of all of them: the keys of a deduplication are
streaming state, and the URLs stored for a file lie in buckets of file names, of which a batch reads its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from hrefmill.operators.ingest import job_counts, new_links, only_new, parse_sources, renumbered
from hrefmill.sources.files import lines_of, relative_name
from hrefmill.storage import cut_lineage
from hrefmill.streaming.folders import BATCH, merge_folders, read_batches, write_batch

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Room for the order numbers of one micro-batch.
SEQ_PER_BATCH = 1 << 40
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEY_BUCKETS = 512
#: Names of files up to which a filter on names is pushed into the stored keys.
PUSHED_NAMES = 1000


def stream_source_files(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """New files below ``root`` as ``filename, modified_at, content``.

    A rewritten file is not seen again: land each revision under a new name.
    """
    text = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .text(root, wholetext=True)
    )
    return text.select(
        relative_name(F.col("_metadata.file_path"), root).alias("filename"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value").alias("content"),
    )


def stream_table(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )


def import_stream(files: DataFrame, jobs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving files into link rows; equal to one batch import of all files. Each file is read once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_sources(cut_lineage(lines_of(batch)), jobs)
        write_batch(new_links(parsed, first_seq=batch_id * SEQ_PER_BATCH), table, batch_id)
        merge_folders(batch.sparkSession, table, batch_id)

    return _start(files, sink, checkpoint)


def _bucket(name: str):
    return F.pmod(F.xxhash64(name), F.lit(KEY_BUCKETS)).cast("int")


_KEY_ORDER = ["bucket", "source_file"]


def stored_keys(spark: SparkSession, keys: str, names: DataFrame, before: int) -> DataFrame | None:
    """``source_file, normalized_url`` stored for some files by batches before one.

    Only the buckets of the names are read, and rows lie there in the order of their file, so that
    a filter on few names skips what lies between. At most ``KEY_BUCKETS`` numbers and ``PUSHED_NAMES`` names reach the driver.
    """
    found = read_batches(spark, keys, before)
    if found is None:
        return None
    names = cut_lineage(names.select("source_file").distinct().withColumn("bucket", _bucket("source_file")))
    found = found.filter(F.col("bucket").isin([r["bucket"] for r in names.select("bucket").distinct().collect()]))
    if names.count() <= PUSHED_NAMES:
        found = found.filter(F.col("source_file").isin([r["source_file"] for r in names.collect()]))
    else:
        found = found.join(names.select("source_file"), "source_file", "left_semi")
    return found.select("source_file", "normalized_url")


def write_keys(added: DataFrame, keys: str, batch_id: int) -> None:
    """Store the keys of new rows in buckets of files."""
    rows = added.select("source_file", "normalized_url").withColumn("bucket", _bucket("source_file"))
    write_batch(rows, keys, batch_id, _KEY_ORDER)
    merge_folders(added.sparkSession, keys, batch_id, order=_KEY_ORDER)


def reparse_stream(files: DataFrame, jobs: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Parse arriving revisions of files; only URLs not yet stored for a file are added.

    Which are stored is looked up below ``{table}-keys``, in the buckets of the files that arrived.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, f"{table}-keys"
        fresh = cut_lineage(
            new_links(parse_sources(cut_lineage(lines_of(batch)), jobs), first_seq=batch_id * SEQ_PER_BATCH)
        )
        stored = stored_keys(spark, keys, fresh, batch_id)
        added = cut_lineage(fresh if stored is None else renumbered(only_new(fresh, stored)))
        write_batch(added, table, batch_id)
        write_keys(added, keys, batch_id)
        merge_folders(spark, table, batch_id)

    return _start(files, sink, checkpoint)


_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key in a batch of rows, so that a key that floods the stream moves few rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by("seq")
        first = ~table.column("key").to_pandas().duplicated()
        yield from table.filter(pa.array(first.to_numpy())).to_batches()


def _first_arrival(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        for _ in rows:
            pass
        return
    best = None
    for some in rows:
        row = some.loc[[some["seq"].idxmin()]]
        if best is None or row["seq"].iloc[0] < best["seq"].iloc[0]:
            best = row
    state.update((int(best["seq"].iloc[0]),))
    yield best[["seq", "row"]]


def first_arrivals(links: DataFrame, key: str) -> DataFrame:
    """The row of each key that arrives first; of rows that arrive together the one with the smallest ``seq``.

    The keys seen are streaming state (one number a key, in RocksDB where the session says so), so a
    micro-batch looks up its own keys and reads no stored rows. A NULL key is a key.
    """
    whole = F.to_json(F.struct(*links.columns), _STAMP)
    packed = links.select(F.col(key).alias("key"), F.col("seq").cast("bigint").alias("seq"), whole.alias("row"))
    schema = T.StructType([packed.schema["key"], T.StructField("seq", T.LongType()), T.StructField("row", T.StringType())])
    kept = (
        packed.mapInArrow(_first_of_task, schema)
        .groupBy("key")
        .applyInPandasWithState(_first_arrival, "seq long, row string", "first long", "append", "NoTimeout")
    )
    return kept.select(F.from_json("row", links.schema, _STAMP).alias("r")).select("r.*")


def dedup_stream(links: DataFrame, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the first arrival of each key, over all batches, as ``first_arrivals`` does."""
    spark = links.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, table, batch_id)
        merge_folders(batch.sparkSession, table, batch_id)

    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)  # a query takes the setting along when it starts
    try:
        return _start(first_arrivals(links, key), sink, checkpoint)
    finally:
        spark.conf.set(_PROVIDER, old)


def dedup_recent(links: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Bounded form: drop repeats of a key that arrive within a delay, with state that expires."""
    return links.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def progress_stream(parsed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Running imported and error counts per file, from ``filename, is_valid``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, table, batch_id)
        merge_folders(batch.sparkSession, table, batch_id, fold=lambda rows: newest_per_key(rows, "filename"))

    return _start(job_counts(parsed), sink, checkpoint, "update")


def status_stream(links: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Running link counts per status; every batch holds all statuses."""
    counts = links.groupBy("status").agg(F.count(F.lit(1)).alias("links"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, table, batch_id)
        merge_folders(batch.sparkSession, table, batch_id, fold=newest_batch)

    return _start(counts, sink, checkpoint, "complete")


def newest_per_key(batches: DataFrame, key: str) -> DataFrame:
    """Newest row of each key among the batches of an updating stream, with its batch."""
    names = [c for c in batches.columns if c != key]
    return batches.groupBy(key).agg(F.max_by(F.struct(*names), BATCH).alias("r")).select(key, "r.*")


def latest_per_key(batches: DataFrame, key: str) -> DataFrame:
    """Newest row of each key among the batches of an updating stream."""
    return newest_per_key(batches, key).drop(BATCH)


def newest_batch(batches: DataFrame) -> DataFrame:
    """Rows of the last batch, with its number."""
    last = batches.agg(F.max(BATCH).alias("__last"))
    return batches.join(F.broadcast(last), F.col(BATCH) == F.col("__last")).drop("__last")


def latest_batch(batches: DataFrame) -> DataFrame:
    """The last batch of a stream that writes its whole result each time."""
    return newest_batch(batches).drop(BATCH)
