"""Connected components of an edge table by distributed union-find.

Each round alternates the two star steps of Kiveris et al. (2014): every vertex
hooks its larger neighbours to its least neighbour (large star), then its smaller
neighbours (small star), until the edge table no longer changes and every vertex
points at the least vertex of its component.  Before the rounds, each partition
contracts its own edges with an array union-find, which removes almost all edges of
dense groups without a shuffle.  The neighbour minimum is a map-side-combined
aggregate; the join back on a hub vertex is an ordinary sort-merge join that AQE
splits.  Rounds are cut by written tables, so a lost executor rereads them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) over the edges a-b, vectorised: labels fall
    to the neighbours' minimum and jump through each other until they are stable."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _contract(batches):
    """Edges of one partition to a star forest; flushed at a fixed number of edges."""
    held, rows = [], 0

    def flush():
        a = np.concatenate([h[0] for h in held])
        b = np.concatenate([h[1] for h in held])
        v, r = union_find(a, b)
        keep = v != r
        return pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(r[keep])], ["v", "r"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
        if rows > 1_000_000:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of an edge that is not its component's least vertex.

    Self-loops, repeated edges and nulls are ignored.  Raises if the rounds do not settle."""
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("r"))
    cur = materialise(e.mapInArrow(_contract, "v long, r long").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # large star: v's larger neighbours go to v's least neighbour (or v)
        both = cur.unionByName(cur.select(F.col("r").alias("v"), F.col("v").alias("r")))
        least = both.groupBy("v").agg(F.min("r").alias("m"))
        big = (both.where(F.col("r") > F.col("v")).join(least, "v")
               .select(F.col("r").alias("v"), F.least("m", "v").alias("r")).distinct())
        # small star: v's smaller neighbours and v go to the least of them
        down = big.groupBy("v").agg(F.min("r").alias("m"))
        small = (big.join(down, "v").where(F.col("r") != F.col("m"))
                 .select(F.col("r").alias("v"), F.col("m").alias("r"))
                 .unionByName(down.select("v", F.col("m").alias("r"))).distinct())
        new = materialise(small.mapInArrow(_contract, "v long, r long").distinct(), "edges")
        seen = tuple(new.agg(F.count(F.lit(1)), F.sum(F.hash("v", "r").cast("long")),
                             F.bit_xor(F.xxhash64("v", "r"))).first())
        release(cur)
        cur = new
        if seen == mark:
            return cur.select("v", F.col("r").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
