"""Cluster quality metrics (M1-M5) as aggregates.

M1/M2 work on the contingency table (one partial aggregate over the rows,
then tiny tables).  M4 (cosine) and
the squared-Euclidean silhouette are linear in per-cluster sums; only M3
(Euclidean) needs per point x cluster distance sums (``pairs.cluster_distance_sums``);
``silhouette_sampled`` estimates it from a bounded sample of points, each scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import pairs


def agreement(df: DataFrame, truth: str, pred: str, swap: bool = False) -> DataFrame:
    """M1: homogeneity, completeness, V-measure, NMI (natural log).

    h = 1 - H(truth|pred)/H(truth) (1 when H(truth)=0); c symmetric;
    v = 2hc/(h+c) (0 when both are 0); NMI with the arithmetic mean equals v.
    ``swap=True`` reproduces the reference's (pred, truth) argument order,
    which exchanges h and c."""
    if swap:
        truth, pred = pred, truth
    cont = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # the marginals and the total are windows over the contingency table: one scan of the rows
    every = Window.partitionBy()
    j = cont.select("n", F.sum("n").over(Window.partitionBy("p")).alias("a"), F.sum("n").over(Window.partitionBy("t")).alias("b"),
                    F.sum("n").over(every).alias("total"))
    part = F.col("n") / F.col("total")
    sums = j.agg((-F.sum(part * F.ln(F.col("n") / F.col("a")))).alias("h_t_given_p"),
                 (-F.sum(part * F.ln(F.col("n") / F.col("b")))).alias("h_p_given_t"),
                 (-F.sum(part * F.ln(F.col("b") / F.col("total")))).alias("h_t"),
                 (-F.sum(part * F.ln(F.col("a") / F.col("total")))).alias("h_p"))
    h_t, h_p = F.col("h_t"), F.col("h_p")
    hom = F.when(h_t > 0, 1 - F.col("h_t_given_p") / h_t).otherwise(F.lit(1.0))
    com = F.when(h_p > 0, 1 - F.col("h_p_given_t") / h_p).otherwise(F.lit(1.0))
    out = sums.select(hom.alias("homogeneity"), com.alias("completeness"))
    v = F.when(F.col("homogeneity") + F.col("completeness") > 0,
               2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))
               ).otherwise(F.lit(0.0))
    out = out.withColumn("v_measure", v).withColumn("nmi", F.col("v_measure"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v_measure", "nmi")])


def sweep_metrics(df: DataFrame, config: str, truth: str, pred: str, more_than: int | None = None,
                  less_than: int | None = None) -> DataFrame:
    """M1, outlier ratio and cluster count (without -1) of every setting, optionally only the
    settings whose cluster count lies strictly between two bounds."""
    cont = df.groupBy(config, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(config, *c))
    j = cont.select(config, "t", "p", "n", over("p").alias("a"), over("t").alias("b"), over().alias("total"))
    part = F.col("n") / F.col("total")
    entropy = lambda x: -F.sum(part * F.ln(x))
    s = j.groupBy(config).agg(entropy(F.col("n") / F.col("a")).alias("h_tp"), entropy(F.col("n") / F.col("b")).alias("h_pt"),
                              entropy(F.col("b") / F.col("total")).alias("h_t"), entropy(F.col("a") / F.col("total")).alias("h_p"),
                              F.sum(F.when(F.col("p") == -1, F.col("n")).otherwise(0.0)).alias("out"), F.sum("n").alias("rows"),
                              F.count_distinct(F.when(F.col("p") != -1, F.col("p"))).alias("n_clusters"))
    hom = F.when(F.col("h_t") > 0, 1 - F.col("h_tp") / F.col("h_t")).otherwise(F.lit(1.0))
    com = F.when(F.col("h_p") > 0, 1 - F.col("h_pt") / F.col("h_p")).otherwise(F.lit(1.0))
    out = s.select(config, hom.alias("hom"), com.alias("com"), (F.col("out") / F.col("rows")).alias("outlier_ratio"), "n_clusters")
    if more_than is not None:
        out = out.filter(F.col("n_clusters") > more_than)
    if less_than is not None:
        out = out.filter(F.col("n_clusters") < less_than)
    both = F.col("hom") + F.col("com")
    return out.select(config, F.round("hom", 6).alias("homogeneity"), F.round("com", 6).alias("completeness"),
                      F.round(F.when(both > 0, 2 * F.col("hom") * F.col("com") / both).otherwise(F.lit(0.0)), 6).alias("v_measure"),
                      F.round("outlier_ratio", 6).alias("outlier_ratio"), "n_clusters")


def outlier_stats(df: DataFrame, pred: str, truth: str | None = None) -> DataFrame:
    """M2: outlier ratio (0 without -1), cluster count including -1, and the
    ratio (k - 1) / k_truth when a truth column is given."""
    cols = [F.round(F.avg((F.col(pred) == -1).cast("double")), 6).alias("outlier_ratio"),
            F.count_distinct(F.col(pred)).cast("bigint").alias("unique_clusters")]
    out = df.agg(*cols)
    if truth is not None:
        kt = df.agg(F.count_distinct(F.col(truth))).scalar()
        out = out.withColumn("clusters_ratio_to_truth", F.round((F.col("unique_clusters") - 1) / kt, 6))
    return out


def silhouette_linear(df: DataFrame, key: str, vec: str, label: str, metric: str = "cosine") -> DataFrame:
    """M4 and its squared-Euclidean sibling: mean silhouette without pairs.

    Both distances are linear in a cluster's sums: with n points, vector sum S and
    sum of squares Q, the distances of x to a cluster sum to n - x.S (cosine, unit
    vectors; a zero vector is 1 away from all) or n x.x - 2 x.S + Q (squared
    Euclidean).  One aggregate per cluster, then points x clusters arithmetic inside
    a row; -1 is one more cluster, singletons score 0.  The clusters' sums (k rows of
    d numbers) go to every task."""
    v = F.col(vec).cast("array<double>")
    if metric == "cosine":
        v = F.coalesce(VF.l2_normalize(v), F.transform(v, lambda x: x * 0.0))
    pts = df.filter(F.col(vec).isNotNull()).select(key, F.col(label).alias("own"), v.alias("x"))
    dims = pts.select("own", F.posexplode("x").alias("dim", "value")).groupBy("own", "dim").agg(F.sum("value").alias("s"))
    sums = dims.groupBy("own").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda p: p["s"]).alias("s"))
    size = pts.groupBy("own").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(VF.dot(F.col("x"), F.col("x"))).alias("q"))
    clusters = size.join(sums, "own").agg(F.collect_list(F.struct("own", "n", "q", "s"))).scalar()
    xx = VF.dot(F.col("x"), F.col("x"))
    t = pts.select("own", "x", xx.alias("xx"), clusters.alias("all"))
    cosine = metric == "cosine"

    def total(c):
        xs = F.aggregate(F.zip_with("x", c["s"], lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y)
        return c["n"] - xs if cosine else c["n"] * F.col("xx") - 2 * xs + c["q"]

    far = t.select("own", "xx", F.transform("all", lambda c: F.struct(c["own"].alias("own"), c["n"].alias("n"), total(c).alias("d"))).alias("far"))
    mine = F.filter("far", lambda c: c["own"] == F.col("own"))[0]
    itself = F.lit(1.0) - F.col("xx") if cosine else F.lit(0.0)  # the point's distance to itself by the formula
    near = F.array_min(F.transform(F.filter("far", lambda c: c["own"] != F.col("own")), lambda c: c["d"] / c["n"]))
    ab = far.select(mine["n"].alias("n"), ((mine["d"] - itself) / F.greatest(mine["n"] - 1, F.lit(1.0))).alias("a"), near.alias("b"))
    top = F.greatest(F.col("a"), F.col("b"))
    s = F.when((F.col("n") <= 1) | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    return ab.agg(F.round(F.avg(s), 6).alias("silhouette"))


def silhouette(df: DataFrame, key: str, vec: str, label: str, metric: str = "euclidean",
               block_rows: int | None = None) -> DataFrame:
    """M3/M4: mean silhouette; -1 is one more cluster; singletons score 0."""
    sums = pairs.cluster_distance_sums(df, key, vec, label, metric, block_rows)
    own = df.select(key, F.col(label).alias("own"))
    j = sums.join(own, key)
    per = j.groupBy(key).agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("dsum") / F.greatest(F.col("cnt") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("cnt"))).alias("n_own"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("dsum") / F.col("cnt"))).alias("b"))
    s = F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b")))
    return per.agg(F.round(F.avg(s), 6).alias("silhouette"))


def silhouette_sampled(df: DataFrame, key: str, vec: str, label: str, n_sample: int = 1000, seed: int = 1) -> DataFrame:
    """M3 estimated: ``silhouette, std_error, n_sampled, n``.

    The ``n_sample`` points of least md5(``<seed>:<key>``) are scored exactly against all points: one pass
    over the vectors, which never move, and partial sums for each (sampled point, cluster).  The sampled
    vectors (``n_sample`` of d numbers, the bound) go to every task.  ``std_error`` is that of the mean of a
    simple random sample drawn without replacement, 0 where all points are in it.  -1 is one more
    cluster, singletons score 0; points without a vector or label do not count, and an empty
    table gives a null score and error."""
    pts = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).alias("lab"), F.col(vec).cast("array<double>").alias("v"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    chosen = pts.orderBy(digest, key).limit(n_sample).select("lab", "v").toArrow()
    own = np.array(chosen["lab"].to_pylist(), dtype=object)
    q = np.array(chosen["v"].to_pylist(), dtype=float)
    length = (q * q).sum(1) if len(q) else None
    kind = pts.schema["lab"].dataType.simpleString()
    names = ["q", "lab", "own", "dsum", "cnt"]

    def run(batches):
        sums, count = {}, {}

        def flush():
            for lab, total in sums.items():
                m = len(q)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(m, dtype=np.int32)), pa.array([lab] * m, lab_type[0]), pa.array(own == lab, pa.bool_()),
                    pa.array(total), pa.array(np.full(m, count[lab], np.int64))], names)
            sums.clear()
            count.clear()

        lab_type = [None]
        for batch in batches if len(q) else ():
            lab_type[0] = batch.column("lab").type
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + length - 2 * (x @ q.T), 0))
                labs = np.array(part.column("lab").to_pylist(), dtype=object)
                for lab in set(labs):
                    mine = labs == lab
                    sums[lab] = d[mine].sum(0) + sums.get(lab, 0)
                    count[lab] = int(mine.sum()) + count.get(lab, 0)
                if len(sums) > 1024:  # (many clusters: what a task holds stays bounded)
                    yield from flush()
        yield from flush()

    far = pts.select("lab", "v").mapInArrow(run, f"q int, lab {kind}, own boolean, dsum double, cnt long")
    per = far.groupBy("q", "lab", "own").agg(F.sum("dsum").alias("d"), F.sum("cnt").alias("c"))
    per = per.groupBy("q").agg(F.max(F.when(F.col("own"), F.col("d") / F.greatest(F.col("c") - 1, F.lit(1)))).alias("a"),
                               F.max(F.when(F.col("own"), F.col("c"))).alias("n_own"),
                               F.min(F.when(~F.col("own"), F.col("d") / F.col("c"))).alias("b"), F.sum("c").alias("n"))
    top = F.greatest("a", "b")
    s = F.when((F.col("n_own") <= 1) | F.col("b").isNull() | (top <= 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / top)
    t = per.select(s.alias("s"), "n").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    error = F.coalesce("sd", F.lit(0.0)) / F.sqrt("m") * F.sqrt(F.greatest(1 - F.col("m") / F.col("n"), F.lit(0.0)))
    return t.select(F.round("mean", 6).alias("silhouette"), F.when(F.col("m") > 0, F.round(error, 6)).alias("std_error"),
                    F.col("m").alias("n_sampled"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def pair_similarity(df: DataFrame, a: str, b: str, threshold: float = 0.0) -> DataFrame:
    """M5: cosine of each vector pair: mean, spread, median and share at or above
    ``threshold`` (all pairs are positives, so this is the accuracy).  Only bounded-state
    aggregates: the median comes from a quantile summary whose rank is off by at most 1 / 10,000
    of the pairs (exact below 10,000 pairs)."""
    cos = VF.cosine(F.col(a), F.col(b))
    per = df.select(cos.alias("cos"))
    return per.agg(F.round(F.avg("cos"), 6).alias("mean_cos"),
                   F.round(F.stddev_samp("cos"), 6).alias("std_cos"),
                   F.round(F.avg((F.col("cos") >= threshold).cast("double")), 6).alias("accuracy"),
                   F.count(F.lit(1)).cast("bigint").alias("pairs"),
                   F.round(F.percentile_approx("cos", 0.5, 10_000), 6).alias("median_cos"))
