"""Term counts per class, class-based TF-IDF and top-n terms.

Everything runs on the long form ``(topic, term, n)``; no dense matrix and no
per-topic list is ever built.  Shuffles: one hash aggregate on (topic, term)
with map-side combine (skew-proof: a hot topic or a hot term is pre-aggregated
before it leaves the map task), one aggregate on term for the idf, one on
topic for the row norm.  Top-n per topic uses ``row_number() <= n``, which
Spark plans with a partial ``WindowGroupLimit`` before the shuffle, so a huge
topic ships at most n rows per map partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(df: DataFrame, topic: str = "topic_label", term: str = "term",
                weight: str | None = "weight") -> DataFrame:
    """Weighted count per (topic, term)."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(topic, term).agg(F.sum(w).cast("bigint").alias("n"))


def _n_docs(n_docs) -> Column:
    if isinstance(n_docs, DataFrame):
        return n_docs.scalar()
    if isinstance(n_docs, Column):
        return n_docs
    return F.lit(n_docs)


def ctfidf(counts: DataFrame, n_docs, topic: str = "topic_label", term: str = "term",
           normalize: bool = True) -> DataFrame:
    """D1 (production form).

    idf(t) = ln(n_docs / sum_c n(t,c)); s = n * idf; score = s / sum_t |s| within
    the topic (0 when the sum is 0).  ``n_docs`` is a number, a Column, or a
    one-row one-column DataFrame (evaluated as a scalar subquery).
    Returns ``topic, term, n, s, score``.
    """
    # counts feed three consumers (term totals, row norms, scores); its exchange
    # is the same subplan each time and is reused within the query
    totals = counts.groupBy(term).agg(F.sum("n").alias("term_total"))
    scored = (counts.join(totals, term)
              .withColumn("s", F.col("n") * F.ln(_n_docs(n_docs).cast("double") / F.col("term_total"))))
    if not normalize:
        return scored.withColumn("score", F.col("s")).drop("term_total")
    norms = scored.groupBy(topic).agg(F.sum(F.abs("s")).alias("l1"))
    return (scored.join(norms, topic)
            .withColumn("score", F.when(F.col("l1") > 0, F.col("s") / F.col("l1")).otherwise(F.lit(0.0)))
            .drop("term_total", "l1"))


def ctfidf_legacy(counts: DataFrame, n_docs, topic: str = "topic_label", term: str = "term") -> DataFrame:
    """D2 (legacy form): tf = n / row total; idf = ln(m / sum_c n(t,c)); score = tf*idf."""
    totals = counts.groupBy(term).agg(F.sum("n").alias("term_total"))
    rows = counts.groupBy(topic).agg(F.sum("n").alias("row_total"))
    return (counts.join(totals, term).join(rows, topic)
            .withColumn("tf", F.col("n") / F.col("row_total"))
            .withColumn("score", F.col("tf") * F.ln(_n_docs(n_docs).cast("double") / F.col("term_total")))
            .drop("term_total", "row_total"))


def top_terms(scored: DataFrame, n: int = 10, topic: str = "topic_label", term: str = "term",
              score: str = "score") -> DataFrame:
    """Best ``n`` terms per topic, ``rank`` 1 = best; ties by term."""
    w = Window.partitionBy(topic).orderBy(F.col(score).desc(), F.col(term).asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def join_ranked(ranked: DataFrame, topic: str = "topic_label", term: str = "term",
                sep: str = ", ", order: str = "desc", rank: str = "rank") -> DataFrame:
    """Ranked terms -> one string per topic (at most n elements per group).

    order="desc" lists the best first; order="asc" reproduces the production
    flow, which lists its best ten worst first.
    """
    asc = order == "asc"
    key = (-F.col(rank)) if asc else F.col(rank)
    agg = ranked.groupBy(topic).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col(term).alias("t")))).alias("l"))
    return agg.select(topic, F.array_join(F.transform("l", lambda x: x["t"]), sep).alias("words"))
