"""The pipeline against its operators on the smallest tables, and on a table of odd rows."""

import collections

import corpus_pipeline
import pytest
from hrefmill.llm import decontaminate, near_dedup, quality, surrogates
from hrefmill.llm.tables import keep

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    expected = {r["doc_id"] for r in quality.judged(docs).filter("kept").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = keep(stage(spark, before, SF))
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if number < 4:
            assert docs.columns == columns, name
        if number == 1:
            expected = {r["class_id"] for r in near_dedup.classes(before).collect()}
        if number == 2:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            expected = {r["doc_id"] for r in decontaminate.report(before, bench).filter("NOT contaminated").collect()}
        assert collections.Counter(ids) == collections.Counter(expected), name
        if number == 3:
            assert docs.filter(docs["text"].rlike(r"\S+@mail\d\.example\.com")).count() == 0
    assert docs.columns == ["doc_id", "text", "token_ids", "n_tokens", "decoded"]


def test_run_equals_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a " * 50, "en", None, None)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    docs.collect()


def test_surrogates_leave_other_documents_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: (r["text"], r["n"]) for r in surrogates.replace(docs, "k", count="n").collect()}
    assert all(found[r["doc_id"]] == (r["text"], 0) for r in docs.collect() if found[r["doc_id"]][1] == 0)
