"""Encoder and reducer properties (no SQL twin for model-derived vectors)."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import embed as EM


def _vectors(spark):
    e = spark.read.parquet(os.path.join(SF_SMALL, "embeddings.parquet"))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def test_default_encoder_unit_vectors(spark):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")).select("doc_id", "text")
    v = EM.embed(docs).select("doc_id", F.size("vec").alias("d"),
                              F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("n2")).collect()
    assert len(v) > 0 and all(r.d == EM.DIM and abs(r.n2 - 1.0) < 1e-9 for r in v)
    again = {r.doc_id: r.vec for r in EM.embed(docs).collect()}
    first = {r.doc_id: r.vec for r in EM.embed(docs).collect()}
    assert again == first  # deterministic


def test_saved_reducer_round_trip(spark):
    df = _vectors(spark)
    model = EM.fit_reducer(df, 8)
    path = tempfile.mkdtemp(prefix="tessera-pca-") + "/m"
    model.write().overwrite().save(path)
    a = {r.id: r.cluster for r in EM.apply_and_cluster(df, path, 0.9, 1, 3).collect()}
    b = {r.id: r.cluster for r in EM.reduce_and_cluster(df, 8, 0.9, 1, 3).collect()}
    assert a == b
    lay = EM.layout(df, 2).collect()
    assert len(lay) == df.count() and all(r.x is not None and r.y is not None for r in lay)


def test_vectors_do_not_depend_on_the_batch(spark):
    from tessera.session import hold
    from tessera.streaming import ingest as ST

    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet")).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, "!")], "doc_id long, text string"))
    encoder = hold(EM.fit_encoder(docs))
    model = EM.fit_reducer(EM.apply_encoder(docs, encoder), 4)
    root = tempfile.mkdtemp(prefix="tessera-flow-")
    model.write().overwrite().save(f"file://{root}/m")
    for part in ("doc_id % 2 = 0", "doc_id % 2 <> 0", "true"):
        out = ST.embedding_flow(spark, docs.filter(part), encoder, f"file://{root}/m", f"file://{root}/v", f"file://{root}/r")
    stored = {r.doc_id: r.vec for r in spark.read.parquet(f"file://{root}/v").collect()}
    whole = {r.doc_id: r.vec for r in EM.apply_encoder(docs, encoder).collect()}
    assert stored.keys() == whole.keys() and len(stored) == docs.count() and stored[-1] is None
    for k, v in whole.items():
        assert (v is None) == (stored[k] is None)
        assert v is None or max(abs(a - b) for a, b in zip(v, stored[k])) < 1e-12
    rows = out.collect()
    assert len(rows) == docs.count() and all((r.reduced is None) == (r.dim is None) for r in rows)


def test_unseen_terms_and_plugged_encoder(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string")
    enc = EM.fit_encoder(docs.filter("doc_id = 1"))
    got = {(r.doc_id, r.term): r.w for r in EM.tfidf_terms(docs, enc).collect()}
    import math
    assert abs(got[2, "gamma"] - (math.log(2) + 1)) < 1e-12 and abs(got[1, "alpha"] - 1) < 1e-12

    class Length:
        def encode(self, texts):
            return [[float(len(t))] for t in texts]

    assert {r.doc_id: r.vec for r in EM.embed_with(docs, Length, batch_size=1).collect()} == {1: [10.0], 2: [11.0]}


def test_reduced_clusters_with_coordinates_and_silhouette(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 6))
    rows = [(k, [float(v) for v in centres[k % 3] + 0.02 * rng.normal(size=6)]) for k in range(30)]
    df = spark.createDataFrame(rows + [(99, None)], "id long, vec array<double>")
    out = {r.id: r for r in EM.reduce_cluster_report(df, 3, 0.2, 1, 3).collect()}
    assert len(out) == 31 and out[99].cluster is None and out[99].x is None
    red = {r.id: np.array(r.reduced) for r in EM.reduce(df, EM.fit_reducer(df, 3)).collect() if r.reduced}
    assert all(abs(out[k].x - v[0]) < 1e-9 and abs(out[k].y - v[1]) < 1e-9 for k, v in red.items())
    assert all((out[a].cluster == out[b].cluster) == (a % 3 == b % 3) for a in range(30) for b in range(30))
    unit = np.array([red[k] / np.linalg.norm(red[k]) for k in range(30)])
    d = 1 - unit @ unit.T
    scores = []
    for k in range(30):
        mean = [sum(d[k, j] for j in range(30) if j % 3 == c and j != k) / (9 if c == k % 3 else 10) for c in range(3)]
        a, b = mean[k % 3], min(mean[c] for c in range(3) if c != k % 3)
        scores.append((b - a) / max(a, b))
    assert {r.silhouette for r in out.values()} == {out[0].silhouette}
    assert abs(out[0].silhouette - np.mean(scores)) < 1e-5


def test_split_keeps_keys_together(spark):
    from tessera.operators import relational as R

    rows = [(k // 2,) for k in range(4000)] + [(None,)]
    got = R.split_rows(spark.createDataFrame(rows, "id long"), "id").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.id, set()).add(r.split)
    assert len(got) == 4001 and all(len(v) == 1 for v in by_key.values()) and by_key[None] == {"train"}
    assert 0.17 < sum(v == {"test"} for v in by_key.values()) / len(by_key) < 0.23
