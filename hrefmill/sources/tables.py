"""Versioned Parquet tables: each publish writes new folders and then one row set naming them.

All tables of one publish become visible together, since readers follow the newest commit only.
One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commit bigint, table string, path string"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COMMITS).parquet(f"{root}/commits")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest_commit(spark: SparkSession, root: str) -> int:
    """Number of the newest commit, 0 when there is none."""
    if not _exists(spark, f"{root}/commits"):
        return 0
    return _commits(spark, root).agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write the next version of some tables and commit them together; returns the commit."""
    commit = latest_commit(spark, root) + 1
    rows = []
    for name, df in tables.items():
        path = f"{root}/{name}/v{commit}"
        df.write.mode("overwrite").parquet(path)
        rows.append((commit, name, path))
    spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return commit


def read_table(spark: SparkSession, root: str, name: str, as_of: int | None = None) -> DataFrame:
    """Newest version of a table, or the one current at an older commit (which restores removed rows)."""
    named = _commits(spark, root).filter(F.col("table") == name)
    if as_of is not None:
        named = named.filter(F.col("commit") <= as_of)
    found = named.agg(F.max_by("path", "commit")).first()[0]
    if found is None:
        raise ValueError(f"no version of {name}")
    return spark.read.parquet(found)
