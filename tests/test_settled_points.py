"""Core graphs of larger tables: the points that groups settle are not compared with all."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import pairs


def _points(spark, n=700):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * 0.5
    x[: n // 8] += 9.0  # a smaller cluster and some noise
    x[-20:] = rng.normal(size=(20, 3)) * 30
    rows = [(k if k % 50 else k + 1, [float(a) for a in v]) for k, v in enumerate(x)]  # (some keys come twice)
    return spark.createDataFrame(rows + [(None, [0.0, 0.0, 0.0]), (9000, None)], "id long, vec array<double>")


def _components(core, edges):
    at = {(r.g, r.id): (r.g, r.id) for r in core.collect()}

    def root(v):
        while at[v] != v:
            v = at[v]
        return v

    for r in edges.collect():  # both ends of an edge are core points
        a, b = sorted((root((r.g, r.src)), root((r.g, r.dst))))
        at[b] = a
    return {v: root(v) for v in at}


def test_core_graphs_with_settled_points_are_the_whole_graphs(spark):
    df, graphs = _points(spark), [(0.5, 1), (0.5, 3), (0.8, 2)]
    want = _components(*pairs.core_graphs(df, graphs, first_from=10 ** 9))
    for size, block in ((150, 64), (4, None)):  # most and few points are settled
        assert _components(*pairs.core_graphs(df, graphs, first_from=1, first_rows=size, block_rows=block)) == want


def test_settled_points_meet_only_the_rest(spark, monkeypatch):
    met = []
    near = pairs.near_tiles

    def tiles(blocked, radius, others=None):
        met.append((blocked.count(), others is not None))
        return near(blocked, radius, others)

    monkeypatch.setattr(pairs, "near_tiles", tiles)
    df = _points(spark).filter(F.col("vec")[0] < 5)
    pairs.core_graphs(df, [(0.8, 2)], first_from=1, first_rows=150)
    assert met and all(one_table and rows < 120 for rows, one_table in met)


def test_sweep_is_the_same_when_points_are_settled(spark, monkeypatch):
    df = _points(spark)
    grid = [C.Setting(0.8, 2, 3), C.Setting(0.3, 1, 5, dim=2)]
    rows = lambda t: sorted((r.config_id, -1 if r.id is None else r.id, r.cluster) for r in t.collect())
    want = rows(C.sweep(df, grid))
    monkeypatch.setattr(pairs, "FIRST_FROM", 1)
    monkeypatch.setattr(pairs, "FIRST_ROWS", 150)
    assert rows(C.sweep(df, grid)) == want
