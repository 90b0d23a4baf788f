"""Plug-in recogniser and encoder: nulls, empty texts, order of spans, one model a task."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import embed as EM
from tessera.operators import recognise as RC

BIG = (1 << 60) + 1  # (more than a double holds)


@pytest.fixture
def rules():
    return lambda: RC.RuleRecogniser("[A-Z][a-z]+", ["EVEN", None])


def test_spans_nulls_and_order(spark, rules):
    rows = [(1, "Hamburg an der Elbe"), (2, None), (3, ""), (4, "nothing here"), (None, "Rhine"), (BIG, "Elbe")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = RC.recognise_with(docs, rules, batch_size=2)
    assert found.count() == len(rows)  # a document without spans keeps its row
    got = [tuple(r) for r in RC.spans(found).orderBy("doc_id", "pos").collect()]
    assert got == [(None, 0, "Rhine", None, 0.8), (1, 0, "Hamburg", None, 1 - 1 / 7), (1, 1, "Elbe", "EVEN", 0.75), (BIG, 0, "Elbe", "EVEN", 0.75)]
    assert [r.text for r in E.filter_score(RC.spans(found), threshold=0.8).collect()] == ["Hamburg"]
    assert RC.recognise_with(docs.limit(0), rules).count() == 0


def test_spans_read_back_as_entity_json(spark, rules):
    docs = spark.createDataFrame([(1, 'Say "Hamburg" to Elbe')], "doc_id long, text string")
    found = RC.recognise_with(docs, rules).select("doc_id", RC.entity_json(F.col("entities")).alias("text"))
    got = {(r.text, r.type) for r in E.parse_entities(found, key="doc_id", fields=["text"]).collect()}
    assert got == {("Say", None), ("Hamburg", None), ("Elbe", "EVEN")}


def test_encoder_keeps_every_row_and_key(spark):
    class Lengths:
        def encode(self, texts):
            return [[len(t), 1] for t in texts]

    big = (1 << 60) + 1
    rows = [(big + k, "x" * k if k else None) for k in range(70)] + [(None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.vec for r in EM.embed_with(docs, Lengths, dim=2, batch_size=8).collect()}
    assert got == {big + k: [float(k), 1.0] for k in range(70)} | {None: [2.0, 1.0]}
