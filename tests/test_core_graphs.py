"""Core graphs leave tiles as counts and forests, never as pairs; blocks grow with the table."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embed as EM
from tessera.operators import graph, pairs


def _df(spark, x, ids):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in zip(ids, x)], "id long, vec array<double>")


def test_edges_do_not_grow_with_the_pairs(spark):
    """300 points that are all neighbours (44,850 pairs), some twice and one without a key."""
    x = np.random.default_rng(2).normal(scale=0.01, size=(300, 4))
    ids = [*range(290), *range(9), None]
    x[290:299] = x[:9]
    core, edges = pairs.core_graphs(_df(spark, x, ids), [(1.0, 1), (1.0, 2), (1e-6, 1)], block_rows=120)
    rows = edges.collect()
    assert sum(r.g == 0 for r in rows) <= 290 * 4 and sum(r.g == 1 for r in rows) <= 290 * 4 and all(r.g < 2 for r in rows)
    for g in (0, 1):
        got = graph.connected_components(core.filter(F.col("g") == g), edges.filter(F.col("g") == g)).collect()
        assert sorted(r.id for r in got) == list(range(290)) and {r.comp for r in got} == {0}


def test_nearest_known_takes_the_lower_key_of_equals(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], False), (9, [0.5, 0.0], True), (8, [-0.5, 0.0], True), (7, [0.0, 0.6], True),
                                (2, [5.0, 5.0], False), (None, [0.1, 0.0], True)], "id long, vec array<double>, old boolean")
    assert [(r.src, r.dst, r.dist) for r in pairs.nearest_known(df, 1.0, "old").collect()] == [(1, 8, 0.5)]


def test_tiles_of_a_vector_do_not_grow():
    assert [-(-n // pairs.block_size(n)) for n in (100, 20_000, 100_000, 500_000)] == [1, 16, 16, 16]
    assert pairs.block_size(10 ** 9) == pairs.MAX_BLOCK_ROWS and pairs.block_size(10 ** 9, 7) == 7


def test_projection_is_the_signed_sum(spark):
    rows = [(d, f"t{k}", 1.0 + (d * k) % 5) for d in range(3) for k in range(20)] + [(3, "t0", 0.0)]
    w = spark.createDataFrame(rows, "doc_id long, term string, w double")
    got = {r.doc_id: r.vec for r in EM.project_terms(w, dim=100).collect()}
    hashes = {r.term: (r.a, r.b) for r in w.select("term", F.xxhash64("term", F.lit(7)).alias("a"), F.xxhash64("term", F.lit(8)).alias("b")).distinct().collect()}
    for d in range(3):
        want = np.zeros(100)
        for doc, term, weight in rows:
            if doc == d:
                want += [weight * (1 - 2 * ((hashes[term][k // 64] >> (k % 64)) & 1)) for k in range(100)]
        assert np.allclose(got[d], want / np.linalg.norm(want), atol=1e-12)
    assert got[3] is None
    # no aggregate of one sum a dimension
    assert "collect_list" in EM.project_terms(w)._jdf.queryExecution().toString()
