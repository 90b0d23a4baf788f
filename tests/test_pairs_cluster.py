"""Exact pair work and clustering against brute force on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import graph, metrics, pairs


def _points(n=120, d=4, seed=3, clusters=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, d)) * 3
    lab = rng.integers(0, clusters, n)
    x = centers[lab] + rng.normal(scale=0.4, size=(n, d))
    return x, lab


def _df(spark, x, lab=None):
    rows = [(int(i), [float(v) for v in x[i]]) + ((int(lab[i]),) if lab is not None else ()) for i in range(len(x))]
    schema = "id long, vec array<double>" + (", cluster int" if lab is not None else "")
    return spark.createDataFrame(rows, schema)


def _dist(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_range_pairs_exact(spark, block_rows):
    x, _ = _points()
    D = _dist(x)
    eps = 1.0
    got = {(r.src, r.dst) for r in pairs.range_pairs(_df(spark, x), eps, block_rows=block_rows).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and D[i, j] <= eps}
    assert got == want


@pytest.mark.parametrize("block_rows", [9, 1024])
def test_knn_exact(spark, block_rows):
    x, _ = _points(n=90)
    D = _dist(x)
    k = 4
    got = {}
    for r in pairs.knn(_df(spark, x), k, block_rows=block_rows, width=0.7).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    for i in range(len(x)):
        order = sorted((D[i, j], j) for j in range(len(x)) if j != i)[:k]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]


def test_search_topk(spark):
    x, _ = _points(n=60)
    df = _df(spark, x)
    q = df.filter(F.col("id") < 5)
    got = {}
    for r in pairs.search_topk(q, df, 3, block_rows=8).collect():
        got.setdefault(r.query, []).append((r.rank, r.match))
    xn = x / np.linalg.norm(x, axis=1, keepdims=True)
    S = xn @ xn.T
    for i in range(5):
        order = sorted(range(len(x)), key=lambda j: (-round(S[i, j], 12), j))[:3]
        assert [m for _, m in sorted(got[i])] == order


def _dbscan_star(x, eps, ms, mcs):
    D = _dist(x)
    n = len(x)
    nb = [[j for j in range(n) if j != i and D[i, j] <= eps] for i in range(n)]
    core = {i for i in range(n) if len(nb[i]) >= ms}
    comp = {}
    for s in sorted(core):
        if s in comp:
            continue
        stack, comp[s] = [s], s
        while stack:
            u = stack.pop()
            for v in nb[u]:
                if v in core and v not in comp:
                    comp[v] = s
                    stack.append(v)
    sizes = {}
    for v, c in comp.items():
        sizes[c] = sizes.get(c, 0) + 1
    keep = sorted(c for c, s in sizes.items() if s >= mcs)
    num = {c: i for i, c in enumerate(keep)}
    return [num.get(comp.get(i), -1) for i in range(n)]


@pytest.mark.parametrize("eps,ms,mcs", [(0.8, 2, 3), (0.5, 1, 3), (1.5, 3, 5)])
def test_density_cluster_brute_force(spark, eps, ms, mcs):
    x, _ = _points()
    want = _dbscan_star(x, eps, ms, mcs)
    got = {r.id: r.cluster for r in C.density_cluster(_df(spark, x), eps, ms, mcs, block_rows=16).collect()}
    assert [got[i] for i in range(len(x))] == want


def test_sweep_matches_single_runs(spark):
    x, _ = _points(n=70)
    grid = [C.Setting(0.8, 2, 3), C.Setting(0.5, 1, 3)]
    rows = C.sweep(_df(spark, x), grid).collect()
    for cfg, s in enumerate(grid):
        got = {r.id: r.cluster for r in rows if r.config_id == cfg}
        assert [got[i] for i in range(len(x))] == _dbscan_star(x, s.eps, s.min_samples, s.min_cluster_size)


def test_sweep_over_alpha_and_dimension(spark):
    """Settings that share a graph, a radius reached by alpha, and reduced dimensions; one setting without any pair."""
    x, _ = _points(n=60)
    grid = [C.Setting(0.8, 2, 3), C.Setting(0.8, 2, 6), C.Setting(0.5, 2, 3, alpha=1.6), C.Setting(0.2, 3, 3, dim=1),
            C.Setting(0.1, 1, 3, alpha=0.5, dim=1), C.Setting(1e-9, 1, 3)]
    rows = C.sweep(_df(spark, x), grid).collect()
    assert len(rows) == len(x) * len(grid)
    for cfg, s in enumerate(grid):
        got = {r.id: r.cluster for r in rows if r.config_id == cfg}
        assert [got[i] for i in range(len(x))] == _dbscan_star(x[:, :s.dim], s.eps * s.alpha, s.min_samples, s.min_cluster_size)


def test_components(spark):
    v = spark.createDataFrame([(i,) for i in [1, 2, 3, 5, 6, 7]], "id long")
    e = spark.createDataFrame([(1, 2), (3, 2), (6, 5)], "src long, dst long")
    got = {r.id: r.comp for r in graph.connected_components(v, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7}


def test_assign_topics_keeps_labels(spark):
    x, _ = _points(n=100)
    df = _df(spark, x)
    old, new = df.filter(F.col("id") < 60), df.filter(F.col("id") >= 60)
    lab = old.join(C.density_cluster(old, 0.8, 2, 3), "id")
    res = {r.id: r.cluster for r in C.assign_topics(new, lab, 0.8, 2, 3).collect()}
    known = {r.id: r.cluster for r in lab.collect()}
    D = _dist(x)
    kmax = max(known.values())
    for i in range(60, 100):
        cands = [(D[i, j], j) for j in range(60) if known[j] != -1 and D[i, j] <= 0.8]
        if cands:
            assert res[i] == known[min(cands)[1]]
        else:
            assert res[i] == -1 or res[i] > kmax


def _silhouette(x, lab, cosine=False):
    if cosine:
        xn = x / np.linalg.norm(x, axis=1, keepdims=True)
        D = 1 - xn @ xn.T
    else:
        D = _dist(x)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_silhouette_brute_force(spark, metric):
    x, lab = _points(n=80)
    got = metrics.silhouette(_df(spark, x, lab), "id", "vec", "cluster", metric, block_rows=11).first().silhouette
    assert abs(got - _silhouette(x, lab, metric == "cosine")) < 1e-6


def test_agreement_symmetry(spark):
    rng = np.random.default_rng(0)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 200), rng.integers(0, 3, 200))]
    df = spark.createDataFrame(rows, "t int, p int")
    ab = metrics.agreement(df, "t", "p").first()
    ba = metrics.agreement(df, "p", "t").first()
    assert abs(ab.homogeneity - ba.completeness) < 1e-9 and abs(ab.completeness - ba.homogeneity) < 1e-9
    same = metrics.agreement(df, "t", "t").first()
    assert same.v_measure == 1.0


def test_zero_and_missing_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    cos = {(r.src, r.dst) for r in pairs.range_pairs(df, 0.1, metric="cosine").collect()}
    assert cos == {(0, 1), (1, 0)}
    euc = {(r.src, r.dst) for r in pairs.range_pairs(df, 0.2).collect()}
    assert euc == {(0, 1), (1, 0)}
    lab = {r.id: r.cluster for r in C.density_cluster(df, 0.2, 1, 2).collect()}
    assert lab == {0: 0, 1: 0, 2: -1, 3: -1, 4: -1}


def test_assign_topics_groups_and_empty_start(spark):
    pts = [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [0.0, 0.1]), (4, [5.0, 5.0]), (5, [5.1, 5.0]), (6, [5.0, 5.1]), (7, [9.0, 0.0])]
    new = spark.createDataFrame(pts, "id long, vec array<double>")
    none = spark.createDataFrame([], "id long, vec array<double>, cluster int")
    got = {r.id: r.cluster for r in C.assign_topics(new, none, 0.5, 1, 3).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: -1}
    known = spark.createDataFrame([(10, [0.0, 0.05], 4), (11, [9.0, 9.0], -1)], "id long, vec array<double>, cluster int")
    got = {r.id: r.cluster for r in C.assign_topics(new, known, 0.5, 1, 3).collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 5, 5: 5, 6: 5, 7: -1}


def test_components_of_a_long_path(spark):
    n = 400
    v = spark.range(n).select(F.col("id"))
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.comp for r in graph.connected_components(v, e).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.connected_components(v, e, max_rounds=1)


def test_sampled_silhouette_within_its_error(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, size=(m, 4)) for c, m in ((0, 300), (2, 60), (5, 1))])
    lab = np.array([0] * 300 + [-1] * 60 + [7])
    df = _df(spark, x, lab)
    exact = _silhouette(x, lab)
    whole = metrics.silhouette_sampled(df, "id", "vec", "cluster", 1000).first()
    assert abs(whole.silhouette - exact) < 1e-6 and whole.std_error == 0 and whole.n_sampled == whole.n == 361
    near = 0
    for seed in range(6):
        some = metrics.silhouette_sampled(df, "id", "vec", "cluster", 80, seed).first()
        assert some.n_sampled == 80 and some.std_error > 0 and abs(some.silhouette - exact) < 4 * some.std_error
        near += abs(some.silhouette - exact) < 2 * some.std_error
    assert near >= 4
    none = metrics.silhouette_sampled(df.limit(0), "id", "vec", "cluster").first()
    assert none.silhouette is None and (none.n_sampled, none.n) == (0, 0)


def test_nothing_stays_cached(spark):
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0
