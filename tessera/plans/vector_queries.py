"""Vector, clustering and metric queries: V2-V5, V9-V11, C1, C5-C7, M1-M5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as VF
from tessera.operators import ann
from tessera.operators import cluster as C
from tessera.operators import graph, metrics, pairs
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import fixtures as FX
from tessera.sources.tables import read_table
from tessera.streaming.ingest import scratch

# Parameters (SURVEY 7.4: eps 1.12 and min_samples 1 give real clusters on the
# unit test vectors; 0.14 would give only noise).
EPS = 1.12
MIN_SAMPLES = 1
MIN_CLUSTER_SIZE = 3
K = 5
TOPIC = 3
SPLIT_AT = "2024-01-02 00:00:00"
GRID = [C.Setting(1.10, 1, 3), C.Setting(1.12, 1, 3), C.Setting(1.12, 2, 3), C.Setting(1.14, 1, 5)]
AXES = [C.Setting(1.12, 1, 3), C.Setting(1.12, 1, 5), C.Setting(1.4, 2, 3, alpha=0.8), C.Setting(0.2, 2, 3, dim=8),
        C.Setting(0.15, 1, 3, alpha=1.2, dim=8), C.Setting(0.32, 1, 3, dim=16)]
TIME_EPS = 1.2


def _emb(spark, base):
    return read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"])


def _pts_sql(src="embeddings", key="vec_id", vec="embedding", where=""):
    return f"SELECT {key} AS id, CAST({vec} AS DOUBLE[]) AS v FROM {src} {where}"


def _c1_ctes(p: str, pts: str, eps: float, ms: int, mcs: int, offset: str = "0"):
    """C1 over the CTE ``pts(id, v)`` -> CTE ``{p}_labels(id, cluster)``."""
    return [
        (f"{p}_pairs", f"""SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 12) AS dist
                           FROM {pts} a JOIN {pts} b ON a.id <> b.id
                           WHERE round(list_distance(a.v, b.v), 12) <= {eps}"""),
        (f"{p}_core", f"SELECT src AS id FROM {p}_pairs GROUP BY src HAVING count(*) >= {ms}"),
        (f"{p}_edges", f"""SELECT src, dst FROM {p}_pairs
                           WHERE src IN (SELECT id FROM {p}_core) AND dst IN (SELECT id FROM {p}_core)"""),
        (f"{p}_reach(id, comp)", f"""SELECT id, id FROM {p}_core
                                     UNION SELECT e.dst, r.comp FROM {p}_reach r JOIN {p}_edges e ON e.src = r.id"""),
        (f"{p}_comp", f"SELECT id, min(comp) AS comp FROM {p}_reach GROUP BY id"),
        (f"{p}_clusters", f"""SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 + {offset} AS INTEGER) AS cluster
                              FROM (SELECT comp FROM {p}_comp GROUP BY comp HAVING count(*) >= {mcs})"""),
        (f"{p}_labels", f"""SELECT x.id, CAST(coalesce(c.cluster, -1) AS INTEGER) AS cluster FROM {pts} x
                            LEFT JOIN {p}_comp m ON m.id = x.id LEFT JOIN {p}_clusters c ON c.comp = m.comp"""),
    ]


def _explode_vec(df, key, vec):
    return (df.select(key, F.posexplode(vec).alias("dim", "value"))
            .select(key, F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value")))


@register("l2_normalize", """
    SELECT vec_id, CAST(dim - 1 AS INTEGER) AS dim, round(value, 6) AS value FROM (
      SELECT vec_id, unnest(u) AS value, generate_subscripts(u, 1) AS dim FROM (
        SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                 sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
          FROM embeddings) WHERE n > 0))""")
def q_l2_normalize(spark, base):
    """V2: unit vectors, long form (vec_id, dim, value)."""
    e = _emb(spark, base).select("vec_id", VF.l2_normalize(F.col("embedding")).alias("u"))
    return _explode_vec(e, "vec_id", "u")


@register("standardize", """
    WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS value,
                      generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
         s AS (SELECT dim, avg(value) AS mu, stddev_pop(value) AS sd FROM x GROUP BY dim)
    SELECT vec_id, CAST(dim AS INTEGER) AS dim,
           round(CASE WHEN sd > 0 THEN (value - mu) / sd ELSE 0.0 END, 6) AS value
    FROM x JOIN s USING (dim)""")
def q_standardize(spark, base):
    """V3: per-dimension z-scores with the population std (long form)."""
    x = _emb(spark, base).select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value"))
    s = x.groupBy("dim").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0))
    return x.join(s, "dim").select("vec_id", F.col("dim").cast("int").alias("dim"), F.round(z, 6).alias("value"))


@register("time_feature", with_views(["article_vectors"], select="""
    SELECT article_uid, round(CASE WHEN hi > lo THEN (t - lo) / (hi - lo) ELSE 0.0 END, 6) AS scaled FROM (
      SELECT article_uid, CAST(floor(epoch_us(article_created_at) / 1000000) AS DOUBLE) AS t,
             (SELECT CAST(floor(min(epoch_us(article_created_at)) / 1000000) AS DOUBLE) FROM article_vectors) AS lo,
             (SELECT CAST(floor(max(epoch_us(article_created_at)) / 1000000) AS DOUBLE) FROM article_vectors) AS hi
      FROM article_vectors)"""))
def q_time_feature(spark, base):
    """V4: min-max scaled timestamp, the extra dimension of the production clustering."""
    av = FX.article_vectors(spark, base)
    t = C.with_time_feature(av, "embedding", "article_created_at", name="v2")
    return t.select("article_uid", F.round(F.element_at("v2", -1), 6).alias("scaled"))


@register("one_hot", with_views(["articles"], select="""
    SELECT a.article_uid, a.department, d.idx, (SELECT count(DISTINCT department) FROM articles) AS n_categories
    FROM articles a JOIN (SELECT department, dense_rank() OVER (ORDER BY department) - 1 AS idx
                          FROM (SELECT DISTINCT department FROM articles)) d USING (department)"""))
def q_one_hot(spark, base):
    """V5: one-hot position of the department (sorted categories) and the width."""
    art = FX.articles(spark, base).select("article_uid", "department")
    idx = graph.dense_index(art, "department", "idx")
    n = art.agg(F.count_distinct("department")).scalar()
    return art.join(idx, "department").select("article_uid", "department", "idx", n.cast("bigint").alias("n_categories"))


@register("vector_pairs", """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cos,
           round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dist
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_vector_pairs(spark, base):
    """V9: cosine and Euclidean distance of vector k and k+1."""
    e = _emb(spark, base)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    j = e.join(b, "vec_id")
    return j.select("vec_id", F.round(VF.cosine(F.col("embedding"), F.col("e2")), 6).alias("cos"),
                    F.round(VF.euclidean(F.col("embedding"), F.col("e2")), 6).alias("dist"))


@register("pair_similarity", """
    WITH p AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS cos
               FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT round(avg(cos), 6) AS mean_cos, round(stddev_samp(cos), 6) AS std_cos,
           round(avg(CASE WHEN cos >= 0.0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS pairs,
           round(quantile_disc(cos, 0.5), 6) AS median_cos FROM p""")
def q_pair_similarity(spark, base):
    """M5 on (k, k+1) vector pairs."""
    e = _emb(spark, base)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return metrics.pair_similarity(e.join(b, "vec_id"), "embedding", "e2")


@register("knn", f"""
    WITH p AS ({_pts_sql()})
    SELECT src, dst, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS rank FROM (
      SELECT a.id AS src, b.id AS dst, round(list_distance(a.v, b.v), 12) AS dist,
             row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.v, b.v), 12), b.id) AS rk
      FROM p a JOIN p b ON a.id <> b.id)
    WHERE rk <= {K}""")
def q_knn(spark, base):
    """Exact 5 nearest neighbours of every vector."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    nn = pairs.knn(e, K)
    return nn.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


@register("knn_approx_recall", """
    SELECT least(5, n - 1) * n AS exact_pairs, true AS recall_reached FROM (SELECT count(*) AS n FROM embeddings)""")
def q_knn_approx_recall(spark, base):
    """Recall of the sorted-code LSH neighbours against the exact ones (0.9 or more)."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    r = ann.recall(ann.approx_knn(e, K), pairs.knn(e, K))
    return r.select("exact_pairs", (F.col("recall") >= 0.9).alias("recall_reached"))


@register("knn_approx")
def q_knn_approx(spark, base):
    """Approximately the 5 nearest neighbours of every vector, in time linear in the vectors."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ann.approx_knn(e, K).select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


_SEARCH_SQL = with_views(["article_vectors", "article_labels", "articles"], select=f"""
    SELECT query, match, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank, a.headline, a.created_at FROM (
      SELECT q.article_uid AS query, c.article_uid AS match,
             list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score,
             row_number() OVER (PARTITION BY q.article_uid ORDER BY
               round(sqrt(greatest(0, 2 - 2 * list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])))), 7),
               c.article_uid) AS rk
      FROM (SELECT v.* FROM article_vectors v JOIN article_labels l USING (article_uid) WHERE l.topic_label = {TOPIC}) q
      JOIN article_vectors c ON TRUE) s
    JOIN articles a ON a.article_uid = s.match
    WHERE rk <= 10""")


def _cell_search(spark, base):
    av = FX.article_vectors(spark, base).select("article_uid", "embedding")
    index = ann.CellIndex.build(av, scratch(spark, "cells"), 32, "article_uid", "embedding")
    q = av.join(FX.article_labels(spark, base).filter(F.col("topic_label") == TOPIC), "article_uid")
    return index, *index.search(q, 10, "article_uid", "embedding")


@register("semantic_search_index", _SEARCH_SQL)
def q_semantic_search_index(spark, base):
    """The same search answered from a stored cell index, exact by the triangle inequality."""
    _, hits, _ = _cell_search(spark, base)
    art = FX.articles(spark, base).select(F.col("article_uid").alias("match"), "headline", "created_at")
    return hits.join(art, "match").select("query", "match", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"),
                                          "headline", "created_at")


@register("search_cells_read")
def q_search_cells_read(spark, base):
    """Cells stored, and how many of them each query of the search read."""
    index, _, reads = _cell_search(spark, base)
    return reads.withColumn("cells", index.cells.agg(F.count(F.lit(1))).scalar())


@register("semantic_search", with_views(["article_vectors", "article_labels", "articles"], select=f"""
    SELECT query, match, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank, a.headline, a.created_at FROM (
      SELECT q.article_uid AS query, c.article_uid AS match,
             round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS score,
             row_number() OVER (PARTITION BY q.article_uid ORDER BY
               round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) DESC,
               c.article_uid) AS rk
      FROM (SELECT v.* FROM article_vectors v JOIN article_labels l USING (article_uid) WHERE l.topic_label = {TOPIC}) q
      JOIN article_vectors c ON TRUE) s
    JOIN articles a ON a.article_uid = s.match
    WHERE rk <= 10"""))
def q_semantic_search(spark, base):
    """10 most similar articles for every article of one topic (itself
    included, score 1), joined to article columns."""
    av = FX.article_vectors(spark, base)
    q = av.join(FX.article_labels(spark, base).filter(F.col("topic_label") == TOPIC), "article_uid")
    hits = pairs.search_topk(q.select(F.col("article_uid").alias("id"), F.col("embedding").alias("vec")),
                             av.select(F.col("article_uid").alias("id"), F.col("embedding").alias("vec")), 10)
    art = FX.articles(spark, base).select(F.col("article_uid").alias("match"), "headline", "created_at")
    return hits.join(art, "match").select("query", "match", F.round("score", 6).alias("score"),
                                          F.col("rank").cast("int").alias("rank"), "headline", "created_at")


register("density_cluster", with_views([], [("pts", _pts_sql())] + _c1_ctes("c", "pts", EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE),
                                      "SELECT id AS vec_id, cluster FROM c_labels", recursive=True))(
    lambda spark, base: C.density_cluster(
        _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")),
        EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE).withColumnRenamed("id", "vec_id"))


def _time_pts_sql():
    return """SELECT article_uid AS id, list_concat(CAST(embedding AS DOUBLE[]),
                 [CASE WHEN hi > lo THEN (t - lo) / (hi - lo) ELSE 0.0 END]) AS v FROM (
                SELECT article_uid, embedding, CAST(floor(epoch_us(article_created_at) / 1000000) AS DOUBLE) AS t,
                  (SELECT CAST(floor(min(epoch_us(article_created_at)) / 1000000) AS DOUBLE) FROM article_vectors) AS lo,
                  (SELECT CAST(floor(max(epoch_us(article_created_at)) / 1000000) AS DOUBLE) FROM article_vectors) AS hi
                FROM article_vectors)"""


register("time_cluster", with_views(["article_vectors"], [("pts", _time_pts_sql())]
                                   + _c1_ctes("c", "pts", TIME_EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE),
                                   "SELECT id AS article_uid, cluster FROM c_labels", recursive=True))(
    lambda spark, base: C.time_cluster(
        FX.article_vectors(spark, base).select(F.col("article_uid").alias("id"), F.col("embedding").alias("vec"),
                                               "article_created_at"),
        TIME_EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE, ts="article_created_at").withColumnRenamed("id", "article_uid"))


def _sweep_ctes(grid):
    """CTEs that end in ``g<i>_labels`` for each setting."""
    ctes = []
    for dim in sorted({s.dim or 0 for s in grid}):
        ctes.append((f"pts{dim}", _pts_sql() if not dim else
                     f"SELECT vec_id AS id, CAST(embedding AS DOUBLE[])[1:{dim}] AS v FROM embeddings"))
    for i, s in enumerate(grid):
        ctes += _c1_ctes(f"g{i}", f"pts{s.dim or 0}", s.eps * s.alpha, s.min_samples, s.min_cluster_size)
    return ctes


def _sweep_sql(grid):
    sel = [f"SELECT {i} AS config_id, id AS vec_id, cluster FROM g{i}_labels" for i in range(len(grid))]
    return with_views([], _sweep_ctes(grid), "\nUNION ALL ".join(sel), recursive=True)


@register("sweep", _sweep_sql(GRID))
def q_sweep(spark, base):
    """C1 for a grid of settings in one plan."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return C.sweep(e, GRID).withColumnRenamed("id", "vec_id")


@register("sweep_axes", lambda: _sweep_sql(AXES))
def q_sweep_axes(spark, base):
    """C6 over all axes: eps, alpha, min_samples, min_cluster_size and the number of leading dimensions."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return C.sweep(e, AXES).withColumnRenamed("id", "vec_id")


def _assign_sql():
    old = f"SELECT article_uid AS id, CAST(embedding AS DOUBLE[]) AS v FROM article_vectors WHERE article_created_at <= TIMESTAMP '{SPLIT_AT}'"
    new = f"SELECT article_uid AS id, CAST(embedding AS DOUBLE[]) AS v FROM article_vectors WHERE article_created_at > TIMESTAMP '{SPLIT_AT}'"
    ctes = [("oldp", old), ("newp", new)] + _later_ctes()
    return with_views(["article_vectors"], ctes,
                      "SELECT id AS article_uid, CAST(cluster AS INTEGER) AS cluster FROM hits "
                      "UNION ALL SELECT id AS article_uid, cluster FROM r_labels", recursive=True)


def _later_ctes():
    """C1 of ``oldp``, then C7 of ``newp`` against it: CTEs o_labels, hits, r_labels."""
    ctes = _c1_ctes("o", "oldp", EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)
    ctes += [
        ("known", "SELECT x.id, x.v, l.cluster FROM oldp x JOIN o_labels l ON l.id = x.id WHERE l.cluster <> -1"),
        ("hits", f"""SELECT id, cluster FROM (
                       SELECT n.id, k.cluster, row_number() OVER (PARTITION BY n.id
                              ORDER BY round(list_distance(n.v, k.v), 12), k.id) AS rk
                       FROM newp n JOIN known k ON round(list_distance(n.v, k.v), 12) <= {EPS}) WHERE rk = 1"""),
        ("restp", "SELECT * FROM newp WHERE id NOT IN (SELECT id FROM hits)"),
    ]
    return ctes + _c1_ctes("r", "restp", EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE,
                           offset="(SELECT coalesce(max(cluster), -1) + 1 FROM o_labels)")


@register("assign_topics", _assign_sql())
def q_assign_topics(spark, base):
    """Articles up to a time are clustered (C1); later arrivals join the
    nearest existing topic within eps or form new topics numbered after it."""
    av = FX.article_vectors(spark, base).select(F.col("article_uid").alias("id"), F.col("embedding").alias("vec"),
                                               "article_created_at")
    cut = F.lit(SPLIT_AT).cast("timestamp_ntz")
    old = av.filter(F.col("article_created_at") <= cut).select("id", "vec")
    new = av.filter(F.col("article_created_at") > cut).select("id", "vec")
    labelled = old.join(C.density_cluster(old, EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE), "id")
    out = C.assign_topics(new, labelled, EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)
    return out.select(F.col("id").alias("article_uid"), "cluster")


@register("agreement", """
    WITH c AS (SELECT quality AS t, toxic AS p, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY 1, 2),
         a AS (SELECT p, sum(n) AS a FROM c GROUP BY p), b AS (SELECT t, sum(n) AS b FROM c GROUP BY t),
         tot AS (SELECT sum(n) AS N FROM c),
         h AS (SELECT -sum(c.n / tot.N * ln(c.n / a.a)) AS htp, -sum(c.n / tot.N * ln(c.n / b.b)) AS hpt
               FROM c JOIN a USING (p) JOIN b USING (t), tot),
         ht AS (SELECT -sum(b / N * ln(b / N)) AS ht FROM b, tot),
         hp AS (SELECT -sum(a / N * ln(a / N)) AS hp FROM a, tot),
         hc AS (SELECT CASE WHEN ht > 0 THEN 1 - htp / ht ELSE 1.0 END AS hom,
                       CASE WHEN hp > 0 THEN 1 - hpt / hp ELSE 1.0 END AS com FROM h, ht, hp)
    SELECT round(hom, 6) AS homogeneity, round(com, 6) AS completeness,
           round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0.0 END, 6) AS v_measure,
           round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0.0 END, 6) AS nmi
    FROM hc""")
def q_agreement(spark, base):
    """M1: two independent labellings (quality vs toxic) of the labelled documents."""
    return metrics.agreement(read_table(spark, base, "labels"), "quality", "toxic")


register("outlier_stats", with_views([], [("pts", _pts_sql())] + _c1_ctes("c", "pts", EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE),
                                    """SELECT round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS outlier_ratio,
                                              count(DISTINCT cluster) AS unique_clusters,
                                              round((count(DISTINCT cluster) - 1) /
                                                    (SELECT count(DISTINCT label) FROM embeddings), 6) AS clusters_ratio_to_truth
                                       FROM c_labels""", recursive=True))(
    lambda spark, base: metrics.outlier_stats(
        C.density_cluster(_emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")),
                          EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE)
        .join(_emb(spark, base).select(F.col("vec_id").alias("id"), "label"), "id"), "cluster", "label"))


SILHOUETTE_SAMPLE = 200  # points scored by the sampling silhouette


def _silhouette_sql(dist: str):
    return f"""
    WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
         d AS (SELECT a.id, a.label AS own, b.label AS cl, sum({dist}) AS s, count(*) AS n
               FROM p a JOIN p b ON TRUE GROUP BY 1, 2, 3),
         per AS (SELECT id, max(CASE WHEN cl = own THEN s / greatest(n - 1, 1) END) AS a,
                        max(CASE WHEN cl = own THEN n END) AS n_own,
                        min(CASE WHEN cl <> own THEN s / n END) AS b FROM d GROUP BY id)
    SELECT round(avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
    FROM per"""


@register("silhouette_euclidean", _silhouette_sql("list_distance(a.v, b.v)"))
def q_silhouette_euclidean(spark, base):
    """M3: exact Euclidean silhouette of the given labels."""
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return metrics.silhouette(e, "id", "vec", "label", "euclidean")


@register("silhouette_sampled", f"""
    WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
         q AS (SELECT * FROM p ORDER BY md5('1:' || id), id LIMIT {SILHOUETTE_SAMPLE}),
         d AS (SELECT a.id, a.label AS own, b.label AS cl, sum(list_distance(a.v, b.v)) AS s, count(*) AS n
               FROM q a JOIN p b ON TRUE GROUP BY 1, 2, 3),
         per AS (SELECT id, max(CASE WHEN cl = own THEN s / greatest(n - 1, 1) END) AS a,
                        max(CASE WHEN cl = own THEN n END) AS n_own,
                        min(CASE WHEN cl <> own THEN s / n END) AS b FROM d GROUP BY id),
         sc AS (SELECT CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM per)
    SELECT round(avg(s), 6) AS silhouette,
           round(stddev_samp(s) / sqrt(count(*)) * sqrt(1 - count(*) / (SELECT count(*) FROM p)), 6) AS std_error,
           count(*) AS n_sampled, (SELECT count(*) FROM p) AS n FROM sc""")
def q_silhouette_sampled(spark, base):
    """M3 from a bounded sample of points (the operator), each scored exactly against all."""
    return metrics.silhouette_sampled(_emb(spark, base), "vec_id", "embedding", "label", SILHOUETTE_SAMPLE)


@register("silhouette_cosine", _silhouette_sql("1.0 - list_cosine_similarity(a.v, b.v)"))
def q_silhouette_cosine(spark, base):
    """M4: exact cosine silhouette of the given labels, from per-cluster sums."""
    return metrics.silhouette_linear(_emb(spark, base), "vec_id", "embedding", "label", "cosine")


@register("silhouette_squared", _silhouette_sql("pow(list_distance(a.v, b.v), 2)"))
def q_silhouette_squared(spark, base):
    """Silhouette by squared Euclidean distances, the form of M3 that scales: linear in per-cluster sums."""
    return metrics.silhouette_linear(_emb(spark, base), "vec_id", "embedding", "label", "squared")


_HALF = "(SELECT (min(vec_id) + max(vec_id)) // 2 FROM embeddings)"


def _label_stream_sql():
    ctes = [("oldp", _pts_sql(where=f"WHERE vec_id <= {_HALF}")), ("newp", _pts_sql(where=f"WHERE vec_id > {_HALF}"))]
    ctes += _later_ctes()
    return with_views([], ctes, "SELECT id AS vec_id, cluster FROM o_labels UNION ALL "
                      "SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster FROM hits "
                      "UNION ALL SELECT id AS vec_id, cluster FROM r_labels", recursive=True)


@register("label_stream", _label_stream_sql)
def q_label_stream(spark, base):
    """Vectors arrive in two batches; the first is clustered (C1), the second labelled
    incrementally (C7) against the stored labels, which never move."""
    from pyspark.sql import types as T

    from tessera.streaming import ingest as ST

    root = ST.scratch(spark, "labels")
    emb = _emb(spark, base)
    low, high = emb.agg(F.min("vec_id"), F.max("vec_id")).first()
    half = (low + high) // 2
    schema = T.StructType([T.StructField("vec_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType())])
    for part in (F.col("vec_id") <= half, F.col("vec_id") > half):
        emb.filter(part).write.mode("append").parquet(f"{root}/source")
        out = ST.label_stream(spark, f"{root}/source", schema, f"{root}/labels", f"{root}/vectors",
                              EPS, MIN_SAMPLES, MIN_CLUSTER_SIZE, key="vec_id", vec="embedding")
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@register("one_hot_vectors", with_views(["article_vectors", "articles"], [
    ("c", """SELECT department, dense_rank() OVER (ORDER BY department) - 1 AS idx, count(*) OVER () AS n
             FROM (SELECT DISTINCT department FROM articles WHERE department IS NOT NULL)"""),
    ("v", """SELECT a.article_uid, list_concat(CAST(a.embedding AS DOUBLE[]), list_transform(
               range(c.n), lambda k: CASE WHEN k = c.idx THEN 1.0 ELSE 0.0 END)) AS v
             FROM article_vectors a JOIN articles b USING (article_uid) JOIN c ON c.department = b.department""")], """
    SELECT article_uid, CAST(dim - 1 AS INTEGER) AS dim, round(value, 6) AS value FROM (
      SELECT article_uid, unnest(v) AS value, generate_subscripts(v, 1) AS dim FROM v)"""))
def q_one_hot_vectors(spark, base):
    """V5: the vector with the one-hot department appended (long form)."""
    art = FX.articles(spark, base).select("article_uid", "department").filter(F.col("department").isNotNull())
    idx = graph.dense_index(art, "department", "idx")
    n = art.agg(F.count_distinct("department")).scalar().cast("int")
    hot = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.when(k == F.col("idx"), F.lit(1.0)).otherwise(F.lit(0.0)))
    j = FX.article_vectors(spark, base).join(art.join(idx, "department"), "article_uid").withColumn("n", n)
    return _explode_vec(j.select("article_uid", F.concat(F.col("embedding").cast("array<double>"), hot).alias("v")), "article_uid", "v")


def _sweep_metrics_sql(grid):
    ctes = _sweep_ctes(grid)
    union = " UNION ALL ".join(f"SELECT {i} AS cfg, l.id, l.cluster AS p, e.label AS t FROM g{i}_labels l JOIN embeddings e ON e.vec_id = l.id"
                               for i in range(len(grid)))
    ctes += [
        ("lab", union),
        ("c", "SELECT cfg, t, p, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY 1, 2, 3"),
        ("j", """SELECT *, sum(n) OVER (PARTITION BY cfg, p) AS a, sum(n) OVER (PARTITION BY cfg, t) AS b,
                        sum(n) OVER (PARTITION BY cfg) AS tot FROM c"""),
        ("h", """SELECT cfg, -sum(n / tot * ln(n / a)) AS htp, -sum(n / tot * ln(n / b)) AS hpt,
                        -sum(n / tot * ln(b / tot)) AS ht, -sum(n / tot * ln(a / tot)) AS hp FROM j GROUP BY cfg"""),
        ("hc", """SELECT cfg, CASE WHEN ht > 0 THEN 1 - htp / ht ELSE 1.0 END AS hom,
                         CASE WHEN hp > 0 THEN 1 - hpt / hp ELSE 1.0 END AS com FROM h"""),
        ("o", """SELECT cfg, round(avg(CASE WHEN p = -1 THEN 1.0 ELSE 0.0 END), 6) AS outlier_ratio,
                        count(DISTINCT CASE WHEN p <> -1 THEN p END) AS n_clusters FROM lab GROUP BY cfg"""),
    ]
    return with_views([], ctes, """
        SELECT CAST(cfg AS INTEGER) AS config_id, round(hom, 6) AS homogeneity, round(com, 6) AS completeness,
               round(CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0.0 END, 6) AS v_measure,
               outlier_ratio, n_clusters FROM hc JOIN o USING (cfg) WHERE n_clusters > 1 AND n_clusters < 25""", recursive=True)


def _sweep_metrics(spark, base, grid):
    e = _emb(spark, base).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    lab = C.sweep(e, grid).join(e.select("id", "label"), "id")
    return metrics.sweep_metrics(lab, "config_id", "label", "cluster", more_than=1, less_than=25)


@register("sweep_metrics", lambda: _sweep_metrics_sql(GRID))
def q_sweep_metrics(spark, base):
    """Metrics of every setting against the given labels; settings with 2 to 24 clusters stay."""
    return _sweep_metrics(spark, base, GRID)


@register("sweep_axes_metrics", lambda: _sweep_metrics_sql(AXES))
def q_sweep_axes_metrics(spark, base):
    """The same over all axes."""
    return _sweep_metrics(spark, base, AXES)
