"""Intermediate tables of the operators, written to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hrefmill.storage import shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def keep(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write are dropped as soon as it has ended. A caller that names the ``folder``
    can ``drop`` the table.
    """
    spark = df.sparkSession
    folder = folder or f"{fresh_folder(spark)}/table"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def drop(spark: SparkSession, *folders: str) -> None:
    """Delete kept tables that no later step reads."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def publish(spark: SparkSession, kind: str, block: bytes) -> str:
    """Put a file of bounded size on all executors by Spark's ``addFile``; returns its name for ``SparkFiles.get``."""
    name = f"{kind}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{fresh_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(block)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def publish_parts(df: DataFrame) -> list[str]:
    """Write a table and put its files on all executors; their names in the order of the partitions."""
    spark = df.sparkSession
    folder = f"{fresh_folder(spark)}/parts"
    keep(df, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    paths = sorted((f.getPath().getName(), f.getPath().toString()) for f in found if f.getPath().getName().startswith("part-"))
    for _, file in paths:
        spark.sparkContext.addFile(file)
    return [name for name, _ in paths]


def fresh(name: str, columns: list[str]) -> str:
    """``name``, prefixed until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
