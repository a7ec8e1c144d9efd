"""Training-data pipeline over ``documents``: each stage works on what the one before it has kept.

Quality rules drop documents, near-dedup keeps one document of each class, decontamination drops documents
with benchmark passages, personal data is replaced, and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hrefmill.llm import bpe, decontaminate, near_dedup, quality, surrogates
from hrefmill.llm.tables import keep

#: Setting that holds the secret key of the surrogates; without it a key for test data is taken.
SURROGATE_KEY = "spark.hrefmill.surrogateKey"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL has no model training, signatures or tokenizer.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the perplexity band of their language."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.distinct(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for their personal data."""
    return surrogates.replace(docs, key=spark.conf.get(SURROGATE_KEY, "surrogates"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, token count and the text that the ids decode to."""
    names = {"token_ids": "token_ids", "n_tokens": "n_tokens", "decoded": "decoded"}
    return bpe.encode(docs.select("doc_id", "text"), bpe.default_tokenizer(), outputs=names)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
