"""Empty tables and null ids, operator by operator and through the whole pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs, library

import corpus_pipeline
from marlstone.llm import decontamination, language, packing, quality, repair

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    """A folder of tables without rows."""
    folder = f"file://{tmp_path_factory.mktemp('none')}"
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{DATA}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_language_of_nothing(spark, none):
    empty, full = spark.read.parquet(f"{none}/documents.parquet"), spark.read.parquet(f"{DATA}/documents.parquet")
    assert language.predict(empty, language.learn(full)).count() == 0
    assert {r["lang_pred"] for r in language.predict(full, language.learn(empty)).collect()} == {"und"}


def test_decontamination_of_and_by_nothing(spark, none):
    table = docs(spark, ["some words here", None, ""])
    benchmark = spark.read.parquet(f"{none}/benchmark.parquet")
    assert decontamination.contamination(table, benchmark).count() == 3
    assert sorted(map(repr, decontamination.clean(table, benchmark).collect())) == sorted(map(repr, table.collect()))
    assert decontamination.clean(table.where("false"), spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
    assert {(len(r["spans"]), len(r["items"])) for r in decontamination.contamination(table, benchmark).collect()} == {(0, 0)}


def test_quality_of_nothing(spark, none):
    empty = spark.read.parquet(f"{none}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality.judge(empty, quality.train(empty, labels)).count() == 0


def test_pipeline_of_nothing(spark, none):
    found = corpus_pipeline.run(spark, none)
    assert found.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(found.columns)


def test_null_ids_are_packed_and_encoded(spark, tmp_path):
    table = docs(spark, ["one two", "three", None]).withColumn("doc_id", F.when(F.col("doc_id") == 2, 7))
    found = packing.pieces(table).collect()
    assert len(found) == 3 and sum(r["length"] for r in found if r["doc_id"] is None) == sum(len(library("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids) + 1 for t in ("one two", "three"))
    folder = f"file://{tmp_path}/ids"
    repair.write(table, folder)
    back = repair.read(spark, folder).collect()
    sizes = sorted(len(library("word_bpe_49k.json").encode(t, add_special_tokens=False).ids) + 1 for t in ("one two", "three", ""))
    assert sorted(r["n_tokens"] for r in back) == sizes and sorted((r["doc_id"] is None) for r in back) == [False, True, True]
    ordered = sorted(back, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == list(np.cumsum([0, *[r["n_tokens"] for r in ordered]])[:-1])
