"""Topic-level operators: sizes, descriptions, summaries.

``describe_topics`` replaces the reference's one-query-per-topic loop by a
single plan over (topic, article, entity): labels join entities on the
article key, then counts, c-TF-IDF and top-n run as grouped operators.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import tfidf


def topic_sizes(labels: DataFrame, topic: str = "topic_label", key: str = "article_uid",
                size_col: str = "topic_size") -> DataFrame:
    """A1: number of rows per topic whose ``key`` column (id, title or text) is not null."""
    return labels.groupBy(topic).agg(F.count(key).cast("bigint").alias(size_col))


def weighted_terms(labels: DataFrame, entity_table: DataFrame, key: str = "article_uid",
                   topic: str = "topic_label", weights: Mapping[str, int] = E.FLOW_WEIGHTS,
                   form: str = "any") -> DataFrame:
    """labels ⋈ entities -> parsed, filtered, weighted term rows
    ``(topic, key, field, term, weight)``."""
    ents = E.parse_entities(entity_table, key=key, form=form)
    ents = E.filter_entities(ents)
    ents = E.weight_entities(ents, weights)
    ents = ents.withColumn("term", E.normalize_term(F.col("text")))
    return labels.select(key, topic).join(ents, key).select(topic, key, "field", "term", "weight")


def describe_topics(labels: DataFrame, entity_table: DataFrame, n_words: int = 10,
                    key: str = "article_uid", topic: str = "topic_label",
                    weights: Mapping[str, int] = E.FLOW_WEIGHTS, include_outliers: bool = True,
                    order: str = "desc") -> DataFrame:
    """D3 + D4: ``topic_label, topic_desc, topic_size`` for every topic.

    n_docs is the number of label rows (all topics, outliers included unless
    ``include_outliers=False``).  Topics without any entity get an empty
    description.
    """
    if not include_outliers:
        labels = labels.filter(F.col(topic) != -1)
    terms = weighted_terms(labels, entity_table, key, topic, weights)
    counts = tfidf.term_counts(terms, topic=topic)
    n_docs = labels.agg(F.count(F.lit(1)))
    scored = tfidf.ctfidf(counts, n_docs, topic=topic)
    words = tfidf.join_ranked(tfidf.top_terms(scored, n_words, topic=topic), topic=topic, order=order)
    sizes = topic_sizes(labels, topic, key)
    return (sizes.join(words, topic, "left")
            .select(F.col(topic).cast("int").alias("topic_label"),
                    F.coalesce(F.col("words"), F.lit("")).alias("topic_desc"),
                    F.col("topic_size")))


def cluster_summary(labels: DataFrame, topic: str = "topic_label") -> DataFrame:
    """A10: outliers, clustered, clustered ratio, clusters without -1."""
    is_out = F.col(topic) == -1
    return labels.agg(
        F.count_if(is_out).cast("bigint").alias("outliers"),
        F.count_if(~is_out).cast("bigint").alias("clustered"),
        F.round(F.try_divide(F.count_if(~is_out).cast("double"), F.count(F.lit(1)).cast("double")), 6).alias("clustered_ratio"),
        F.count_distinct(F.when(~is_out, F.col(topic))).cast("bigint").alias("n_clusters"))


def link_topics(labels: DataFrame, articles: DataFrame, key: str = "article_uid",
                points: DataFrame | None = None, swap_titles: bool = False) -> DataFrame:
    """Align labels (and optional coordinates) with article columns by key
    join -- the reference zips arrays by position.  ``swap_titles`` keeps its
    headline/seo_title swap of ``link_to_raw_data``."""
    cols = [key, "headline", "seo_title", "text", "created_at"]
    art = articles.select(*cols)
    if swap_titles:
        art = art.select(key, F.col("seo_title").alias("headline"), F.col("headline").alias("seo_title"),
                         "text", "created_at")
    out = labels.join(art, key)
    if points is not None:
        out = out.join(points, key)
    return out.withColumn("created_at", F.date_format(F.to_date("created_at"), "yyyy-MM-dd"))
