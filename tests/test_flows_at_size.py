"""The flows store and move no more than they need."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators import embed as EM
from tessera.plans import flow_queries as FQ
from tessera.session import hold
from tessera.sources import tables
from tessera.streaming import ingest as ST


def _base(spark, rows):
    base = tempfile.mkdtemp(prefix="tessera-flows-")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "de", "s", len(t or "")) for k, t in rows], schema).coalesce(1).write.parquet(f"{base}/documents.parquet")
    return base


ROWS = [(k, f"Kopf {k}\nalpha beta w{k % 40} x{k % 7} y{k % 33}") for k in range(60)]


def test_stream_keeps_one_row_of_a_key_and_moves_no_text(spark):
    base = _base(spark, ROWS + [ROWS[3], (None, "alpha"), (None, "beta"), (99, None)])
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    encoder = hold(EM.fit_encoder(docs), "encoder")
    plan = EM.apply_encoder(docs, encoder, one_each=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "text" not in plan[:plan.index("MapInArrow", plan.index("Exchange"))]
    EM.fit_reducer(EM.apply_encoder(docs, encoder), 4).write().overwrite().save(f"file://{base}/m")
    got = ST.embed_stream(spark, f"{base}/documents.parquet", docs.schema, encoder, f"file://{base}/m", f"{base}/v", f"{base}/r").collect()
    assert len(got) == 62 and {r.doc_id: r.vec for r in got}[99] is None and {r.doc_id: r.vec for r in got}[None] is None
    assert [r.same for r in FQ.q_embed_stream(spark, base).filter("doc_id = 3").collect()] == [True, True]


def test_flow_fits_on_stored_vectors(spark, monkeypatch):
    fit, seen = EM.fit_reducer, []
    monkeypatch.setattr(EM, "fit_reducer", lambda df, *a, **b: seen.append(hasattr(df, "_held_path")) or fit(df, *a, **b))
    out = FQ.q_embedding_flow(spark, _base(spark, ROWS)).collect()
    assert seen == [True] and len(out) == 60 and all(r.dim == EM.DIM and len(r.reduced) == FQ.REDUCED_DIM for r in out)


def test_ingested_batch_is_not_stored_twice(spark, monkeypatch):
    append, seen = tables.append, []
    monkeypatch.setattr(tables, "append", lambda df, *a: seen.append("batch-" in str(df._jdf.queryExecution().optimizedPlan()) + "".join(df.inputFiles())) or append(df, *a))
    out = FQ.q_ingest_new(spark, _base(spark, ROWS + [ROWS[3]]))
    assert seen == [False] and sorted(r.article_uid for r in out.collect()) == list(range(60))
    store = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    assert store.filter(F.size("vec") == EM.DIM).count() == 60
