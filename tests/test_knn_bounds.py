"""The second pass of the exact neighbours carries each row's own bound."""

import numpy as np

from tessera.operators import pairs


def test_second_pass_keeps_what_is_within_a_rows_bound(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(240, 4)), 2)
    x[200:] = x[:40]  # equal vectors tie by the lower key
    keys = [f"k{k:03d}" for k in rng.permutation(240)]
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in zip(keys, x)], "id string, vec array<double>")
    ship, carried = pairs._ship, []
    monkeypatch.setattr(pairs, "_ship", lambda b, t, key, vec, *more: carried.append(more) or ship(b, t, key, vec, *more))
    got = {}
    for r in pairs.knn(df, 3, block_rows=20).collect():
        got.setdefault(r.src, []).append((r["rank"], round(r.dist, 6), r.dst))
    assert carried == [(), ("u",)]
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, k in enumerate(keys):
        want = sorted((round(float(dist[i, j]), 6), keys[j]) for j in range(240) if j != i)[:3]
        assert [d for _, d, _ in sorted(got[k])] == [d for d, _ in want]


def test_null_and_repeated_keys(spark):
    rows = [(1, [0.0]), (1, [0.0]), (2, [1.0]), (None, [3.0]), (None, [3.5]), (4, [5.0])]
    got = {(r.src, r["rank"]): (r.dst, round(r.dist, 6)) for r in pairs.knn(spark.createDataFrame(rows, "id long, vec array<double>"), 2).collect()}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (2, 1.0)  # (a key is no neighbour of itself, its rows are one source)
    assert got[2, 1] == (1, 1.0) and got[4, 1] == (None, 1.5)
