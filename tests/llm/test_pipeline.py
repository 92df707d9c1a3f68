"""The corpus pipeline: columns, kept and dropped documents, odd inputs."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.operators.materialize import materialize

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="testdata not present")


def test_stages_are_registered_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "personal_data", "packing"]
    assert "pipeline" in entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1


@pytest.mark.parametrize("table", ["messy", "nothing"])
def test_odd_documents_through_every_stage(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.dtypes == before.dtypes
        if name == "near_duplicates" and table == "messy":
            ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and 5 in ids and 31 not in ids and 8 not in ids
        if name == "personal_data" and table == "messy":
            assert [r.text for r in docs.filter("doc_id = 12").collect()] == ["[CARD] é😀 [EMAIL] ŰÑ"]
            assert docs.filter("n_chars <> length(text)").count() == 0
    assert (docs.count() > 0) == (table == "messy")
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_clean_documents_stay_and_toxic_ones_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, "/root/testdata/sf0.01")
    assert kept.count() >= 0.99 * docs.count()
    left = corpus_pipeline.toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stay = labels.join(left, "doc_id").groupBy("toxic").count().collect()
    number = {r.toxic: r["count"] for r in stay}
    total = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert number[0] >= 0.98 * total[0] and number.get(1, 0) <= 0.25 * total[1]
