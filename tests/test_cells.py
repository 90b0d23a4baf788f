"""Range pairs: cells prune, hot cells split, probes never meet known against known."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import pairs


def _vectors(spark, x, extra=None):
    rows = [(i, [float(a) for a in v], bool(extra is None or extra[i])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>, fresh boolean")


def _clustered(n, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(2, n // 50), d))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = centers[rng.integers(0, len(centers), n)] + rng.normal(scale=0.01, size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _layout(spark, n):
    """(blocks, tiles, rows shipped) at the production eps."""
    t = _vectors(spark, _clustered(n)).select("id", F.col("vec").alias("v"), F.lit(True).alias("probe"))
    blocked = pairs._cells(t, "id", 0.14, 256, 5, 8).cache()
    tiles = pairs.near_tiles(blocked, 0.14)
    size = blocked.groupBy("block").count()
    ends = tiles.select(F.col("a").alias("block")).unionByName(tiles.filter("a != b").select(F.col("b").alias("block")))
    out = size.count(), tiles.count(), ends.join(size, "block").agg(F.sum("count")).first()[0]
    blocked.unpersist()
    return out


def test_tiles_are_pruned_and_shipping_grows_linearly(spark):
    b1, t1, r1 = _layout(spark, 5_000)
    b2, t2, r2 = _layout(spark, 20_000)
    assert t2 < 0.2 * b2 * (b2 + 1) / 2
    assert r2 < 4 * r1 * 1.6


def test_probes_only(spark):
    x = _clustered(300, d=4)
    fresh = np.arange(300) % 3 == 0
    df = _vectors(spark, x, fresh)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(300) for j in range(300) if i != j and dist[i, j] <= 0.3 and (fresh[i] or fresh[j])}
    for rows in (11, 1024):
        got = [(r.src, r.dst) for r in pairs.range_pairs(df, 0.3, block_rows=rows, probe=F.col("fresh")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_rows_and_one_dimension(spark):
    df = spark.createDataFrame([], "id long, vec array<double>")
    assert pairs.range_pairs(df, 1.0).collect() == []
    one = spark.createDataFrame([(1, [0.0]), (2, [0.5]), (3, [2.0]), (4, None)], "id long, vec array<double>")
    assert {(r.src, r.dst) for r in pairs.range_pairs(one, 0.5).collect()} == {(1, 2), (2, 1)}
