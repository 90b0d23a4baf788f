"""Density clustering (C1, C5, C6, C7) on the exact core graph.

C1 is DBSCAN* at a fixed distance: d(p,q) = metric / alpha; p is core when
at least ``min_samples`` other points are within eps; core points closer than
eps are linked; components with at least ``min_cluster_size`` points are
clusters, numbered densely (from 0) by their least key; everything else is -1.
Pairs never become rows: tiles return neighbour counts and spanning forests
(``pairs.core_graphs``), which have the components of the whole graph.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import graph, pairs
from tessera.session import hold


def label_components(points: DataFrame, edges: DataFrame, core: DataFrame, key: str,
                     min_cluster_size: int, offset=0) -> DataFrame:
    """Components of the core graph -> (key, cluster) with -1 for the rest."""
    comp = graph.connected_components(core, edges, vid="id")
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cluster_size)
    idx = graph.dense_index(sizes, "comp", "cluster")
    lab = comp.join(idx, "comp").select(F.col("id").alias(key), (F.col("cluster") + offset).cast("int").alias("cluster"))
    return (points.select(key).join(lab, key, "left")
            .select(key, F.coalesce(F.col("cluster"), F.lit(-1)).cast("int").alias("cluster")))


def density_cluster(df: DataFrame, eps: float, min_samples: int = 2, min_cluster_size: int = 3,
                    key: str = "id", vec: str = "vec", alpha: float = 1.0, metric: str = "euclidean",
                    block_rows: int | None = None) -> DataFrame:
    """``(key, cluster)``, -1 = noise."""
    core, edges = pairs.core_graphs(df.select(key, vec), [(eps * alpha, min_samples)], key=key, vec=vec, block_rows=block_rows,
                                    metric=metric)
    return label_components(df, edges, core, key, min_cluster_size)


def with_time_feature(df: DataFrame, vec: str = "vec", ts: str = "created_at", name: str | None = None) -> DataFrame:
    """V4: min-max scaled unix seconds appended as one more dimension
    (a constant column scales to 0)."""
    secs = F.unix_timestamp(F.col(ts).cast("timestamp")).cast("double")
    lo = df.agg(F.min(F.unix_timestamp(F.col(ts).cast("timestamp")))).scalar().cast("double")
    hi = df.agg(F.max(F.unix_timestamp(F.col(ts).cast("timestamp")))).scalar().cast("double")
    scaled = F.when(hi > lo, (secs - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return df.withColumn(name or vec, VF.append(F.col(vec), scaled))


def time_cluster(df: DataFrame, eps: float, min_samples: int, min_cluster_size: int, key: str = "id",
                 vec: str = "vec", ts: str = "created_at") -> DataFrame:
    """C1 on vectors with the scaled time appended (production path)."""
    return density_cluster(with_time_feature(df, vec, ts), eps, min_samples, min_cluster_size, key, vec)


@dataclass(frozen=True)
class Setting:
    """One point of a sweep.  ``alpha`` scales the distance (d = metric / alpha); ``dim``: only the first
    ``dim`` coordinates count, which for vectors of the reducer (coordinates by falling variance)
    is the reduction to that many dimensions."""

    eps: float
    min_samples: int
    min_cluster_size: int
    alpha: float = 1.0
    dim: int | None = None

    @property
    def step(self) -> tuple[int, float]:
        return self.dim or 0, float(self.eps * self.alpha)


def _table(values: Sequence[Sequence[tuple]], *names: str):
    """Literal array of arrays of structs of ints."""
    return F.array(*[F.array(*[F.struct(*[F.lit(int(x)).alias(n) for n, x in zip(names, row)]) for row in rows])
                     for rows in values])


def sweep(df: DataFrame, grid: Sequence[Setting], key: str = "id", vec: str = "vec") -> DataFrame:
    """C1 for every setting in one plan: ``(config_id, key, cluster)``.

    Settings share work where they may: one or two passes over the tiles for each dimension (at its largest
    radius), neighbour counts for each (dimension, radius), components for each (dimension, radius, min_samples);
    min_cluster_size only picks among those components.  So a grid of thousands of settings costs as many
    graphs as it has different (dimension, radius, min_samples).  The vertices of the component job are
    (graph, point)."""
    graphs = sorted({(s.step, s.min_samples) for s in grid})
    core = edges = None
    for dim in sorted({d for (d, _), _ in graphs}):
        pts = df.select(key, (F.slice(vec, 1, dim) if dim else F.col(vec)).alias(vec))
        mine = [g for g, ((d, _), _) in enumerate(graphs) if d == dim]
        some, links = pairs.core_graphs(pts, [(graphs[g][0][1], graphs[g][1]) for g in mine], key=key, vec=vec)
        numbers = F.array(*[F.lit(g) for g in mine])
        vertex = lambda c: F.struct(F.element_at(numbers, F.col("g") + 1).alias("g"), F.col(c).alias("p"))
        some, links = some.select(vertex("id").alias("id")), links.select(vertex("src").alias("src"), vertex("dst").alias("dst"))
        core, edges = (some, links) if core is None else (core.unionByName(some), edges.unionByName(links))
    comp = graph.connected_components(core, edges)
    comp = comp.select(F.col("id.g").alias("g"), F.col("id.p").alias(key), F.col("comp.p").alias("comp"))
    of_graph = _table([[(i, s.min_cluster_size) for i, s in enumerate(grid) if (s.step, s.min_samples) == g]
                       for g in graphs], "cfg", "mcs")
    sizes = comp.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("comp", F.explode(F.filter(F.element_at(of_graph, F.col("g") + 1),
                                                    lambda c: c["mcs"] <= F.col("n"))).alias("c"), "g")
    sizes = sizes.select("g", "comp", F.col("c.cfg").alias("cfg"))
    idx = graph.dense_index_by(sizes, "cfg", "comp", "cluster").join(sizes, ["cfg", "comp"])
    lab = comp.join(idx, ["g", "comp"]).select("cfg", key, "cluster")
    allp = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("cfg"))
    return (allp.join(lab, ["cfg", key], "left")
            .select(F.col("cfg").alias("config_id"), key,
                    F.coalesce(F.col("cluster"), F.lit(-1)).cast("int").alias("cluster")))


def assign_topics(new: DataFrame, labelled: DataFrame, eps: float, min_samples: int = 2,
                  min_cluster_size: int = 3, key: str = "id", vec: str = "vec",
                  label: str = "cluster") -> DataFrame:
    """Label new vectors with existing topics, new topics as they arise.

    A new vector takes the label of its nearest labelled (non-noise) vector if
    that one is within eps; the rest are clustered by C1 among themselves and
    numbered after the current largest label.  Existing labels never move."""
    lab = labelled.select(key, vec, F.col(label).alias("lab"))
    known = lab.filter((F.col("lab") != -1) & F.col(key).isNotNull())
    both = (new.select(key, vec, F.lit(False).alias("known"))
            .unionByName(known.select(key, vec, F.lit(True).alias("known"))))
    nearest = pairs.nearest_known(both, eps, "known", key=key, vec=vec)
    label_of = known.groupBy(F.col(key).alias("dst")).agg(F.min("lab").alias("lab"))
    hit = hold(nearest.join(label_of, "dst").select(F.col("src").alias(key), F.col("lab").cast("int").alias(label)), "hits")
    rest = new.select(key, vec).join(hit.select(key), key, "left_anti")
    offset = labelled.agg(F.coalesce(F.max(F.col(label)), F.lit(-1)) + 1).scalar()
    core, edges = pairs.core_graphs(rest.filter(F.col(key).isNotNull()), [(eps, min_samples)], key=key, vec=vec)
    fresh = label_components(rest, edges, core, key, min_cluster_size, offset=offset)
    fresh = fresh.withColumnRenamed("cluster", label)
    return hit.unionByName(fresh)
