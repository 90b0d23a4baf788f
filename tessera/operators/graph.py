"""Graph operators as iterated DataFrame jobs: connected components, dense ids.

Connected components use min-label propagation with pointer jumping:
``lab <- least(lab, min(lab of neighbours))`` then ``lab <- lab(lab)`` until no
label changes.  The neighbour minimum is a partial aggregate (a hub vertex is
combined map-side); the pointer-jump join is keyed on labels, which AQE's skew
join splits when one component holds a large share of the vertices.  Each round
is written to the session's checkpoint folder and the round before is deleted,
so a lost executor rereads one round and shared storage holds two at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import drop, hold


def connected_components(vertices: DataFrame, edges: DataFrame, vid: str = "id",
                         src: str = "src", dst: str = "dst", hops: int = 2,
                         max_rounds: int = 1000) -> DataFrame:
    """``(id, comp)``: comp = least vertex id of the component.

    ``edges`` may come in one or both directions.  Vertices without edges are
    their own component.  Runs until a round changes nothing; ``max_rounds``
    only raises (labels at least halve their distance to the minimum each
    round, so it is never reached by a graph that fits any cluster)."""
    one = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col("a") != F.col("b")).distinct()
    one = hold(one, "edges")
    e = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    v = vertices.select(F.col(vid).alias("v")).distinct()
    # round 0: each vertex takes the least of itself and its neighbours
    first = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    lab = hold(v.join(first, "v", "left")
               .select("v", F.least(F.col("v"), F.coalesce(F.col("m"), F.col("v"))).alias("lab")), "labels")
    for _ in range(max_rounds):
        nb = (e.join(lab.withColumnRenamed("v", "b"), "b")
              .groupBy(F.col("a").alias("v")).agg(F.min("lab").alias("m")))
        cur = (lab.join(nb, "v", "left")
               .select("v", F.col("lab").alias("old"),
                       F.least(F.col("lab"), F.coalesce(F.col("m"), F.col("lab"))).alias("l")))
        # pointer jumping through the previous round's labels, ``hops`` times in one job: l -> label of l
        for _ in range(hops):
            hop = lab.select(F.col("v").alias("l"), F.col("lab").alias("l2"))
            cur = (cur.join(hop, "l", "left")
                   .select("v", "old", F.least(F.col("l"), F.coalesce(F.col("l2"), F.col("l"))).alias("l")))
        new = hold(cur.select("v", F.col("l").alias("lab"), (F.col("l") != F.col("old")).alias("changed")), "labels")
        settled = new.filter("changed").isEmpty()
        drop(lab)
        lab = new.select("v", "lab")
        lab._held_path = new._held_path
        if settled:
            drop(one)
            return lab.select(F.col("v").alias(vid), F.col("lab").alias("comp"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dense_index(values: DataFrame, col: str, name: str = "idx") -> DataFrame:
    """Dense 0-based rank of the distinct values of ``col`` without moving all of
    them into one task: range partitions, a rank inside each, and the offset of
    each partition (one row per partition) from its predecessors' sizes."""
    placed = hold(values.select(col).distinct().repartitionByRange(F.col(col))
                  .select(col, F.spark_partition_id().alias("_part")), "ranked")
    inside = Window.partitionBy("_part").orderBy(col)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (placed.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, "_part")
            .select(col, (F.col("_rank") + F.col("_start")).cast("long").alias(name)))


def dense_index_by(values: DataFrame, group: str, col: str, name: str = "idx") -> DataFrame:
    """Dense 0-based rank of ``col`` within each ``group``: one global
    distributed ranking of (group, col), minus each group's first index."""
    keyed = values.select(F.struct(group, col).alias("k")).distinct()
    ranked = dense_index(keyed, "k", "g")
    first = ranked.groupBy(F.col("k")[group].alias(group)).agg(F.min("g").alias("g0"))
    return (ranked.select(F.col("k")[group].alias(group), F.col("k")[col].alias(col), "g")
            .join(first, group).select(group, col, (F.col("g") - F.col("g0")).cast("int").alias(name)))
