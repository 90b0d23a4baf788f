"""Topic description queries: D1-D6, F11-F17, A1, A10, T1, T2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import tfidf, topics
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import fixtures as FX

def _flagship(spark, base, n_words=10):
    labels = FX.article_labels(spark, base)
    ents = FX.entities(spark, base)
    return topics.describe_topics(labels, ents, n_words=n_words)


register("topic_report", with_views(["topic_table"], select="""
    SELECT topic_label, topic_desc, topic_size FROM topic_table"""))(_flagship)


_ENT_COLS = ["article_uid", "field", "text", "type", "salience"]


@register("parse_entities", with_views(["entities_long"], select="""
    SELECT article_uid, field, text, type, round(salience, 6) AS salience FROM entities_long"""))
def q_parse_entities(spark, base):
    """F12 on the three JSON fields of every article."""
    ents = E.parse_entities(FX.entities(spark, base), form="any")
    return ents.select(*_ENT_COLS[:-1], F.round("salience", 6).alias("salience"))


@register("filter_entities", with_views(["entities_long"], select="""
    SELECT article_uid, field, text, type, round(salience, 6) AS salience FROM entities_long
    WHERE type IS NOT NULL AND NOT contains(lower(text), 'bild')
      AND NOT contains(type, 'UNKNOWN') AND NOT contains(type, 'NUMBER')"""))
def q_filter_entities(spark, base):
    """F14 after F12."""
    ents = E.filter_entities(E.parse_entities(FX.entities(spark, base)))
    return ents.select(*_ENT_COLS[:-1], F.round("salience", 6).alias("salience"))


@register("weighted_entities", with_views(["weighted"], select="""
    SELECT topic_label, article_uid, field, term, weight FROM weighted"""))
def q_weighted_entities(spark, base):
    """F16 + F17 joined to topic labels: one row per (topic, article, field, entity)."""
    t = topics.weighted_terms(FX.article_labels(spark, base), FX.entities(spark, base))
    return t.withColumn("weight", F.col("weight").cast("int"))


@register("ctfidf", with_views(["scored"], select="""
    SELECT topic_label, term, n, round(score, 6) AS score FROM scored"""))
def q_ctfidf(spark, base):
    """D1 over weighted entity terms, every (topic, term)."""
    labels = FX.article_labels(spark, base)
    terms = topics.weighted_terms(labels, FX.entities(spark, base))
    scored = tfidf.ctfidf(tfidf.term_counts(terms), labels.agg(F.count(F.lit(1))))
    return scored.select("topic_label", "term", "n", F.round("score", 6).alias("score"))


# Legacy form (D2): texts of each topic tokenised the vectoriser's way
# (lower case, runs of >= 2 word characters), stopwords removed, m = articles.
def _legacy_scored(spark, base):
    from tessera.functions import text as TX

    labels = FX.article_labels(spark, base)
    docs = FX.articles(spark, base).select("article_uid", "text")
    toks = labels.join(docs, "article_uid").select(
        "topic_label", F.explode(TX.remove_stopwords(TX.vectorizer_tokens("text"))).alias("term"))
    counts = tfidf.term_counts(toks, weight=None)
    return tfidf.ctfidf_legacy(counts, labels.agg(F.count(F.lit(1))))


def _legacy_sql():
    from tessera.functions import text as TX
    from tessera.plans import sqltext as SQ

    return [
        ("ltoks", f"""
            SELECT l.topic_label, unnest(list_filter(regexp_extract_all(lower(a.text), '{TX.WORD}{{2,}}'),
                     lambda x: NOT list_contains({SQ.str_list(TX.stopwords())}, x))) AS term
            FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid"""),
        ("lcounts", "SELECT topic_label, term, CAST(count(*) AS BIGINT) AS n FROM ltoks GROUP BY topic_label, term"),
        ("lscored", """
            SELECT c.topic_label, c.term, c.n,
                   (CAST(c.n AS DOUBLE) / r.row_total)
                   * ln(CAST((SELECT count(*) FROM article_labels) AS DOUBLE) / t.term_total) AS score
            FROM lcounts c
            JOIN (SELECT term, sum(n) AS term_total FROM lcounts GROUP BY term) t ON t.term = c.term
            JOIN (SELECT topic_label, sum(n) AS row_total FROM lcounts GROUP BY topic_label) r
              ON r.topic_label = c.topic_label"""),
    ]


register("ctfidf_legacy", lambda: with_views(["article_labels", "articles"], _legacy_sql(), """
    SELECT topic_label, term, n, round(score, 6) AS score FROM lscored"""))(
    lambda spark, base: _legacy_scored(spark, base).select(
        "topic_label", "term", "n", F.round("score", 6).alias("score")))


@register("top_terms", lambda: with_views(["article_labels", "articles"], _legacy_sql(), """
    SELECT topic_label, CAST(rk AS INTEGER) AS rank, term, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY score DESC, term) AS rk FROM lscored)
    WHERE rk <= 20"""))
def q_top_terms(spark, base):
    """20 best legacy c-TF-IDF terms per topic."""
    top = tfidf.top_terms(_legacy_scored(spark, base), 20)
    return top.select("topic_label", F.col("rank").cast("int").alias("rank"), "term",
                      F.round("score", 6).alias("score"))


# Counter summary -- entities counted with weights text 1, title 2,
# kicker 3 (missing type -> COMMON; NUMBER and COMMON dropped), 8 best joined by " | ".
_EVAL_CASE = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in E.EVAL_WEIGHTS.items()) + " END"


@register("top_entities", with_views(["article_labels", "entities_long"], [
    ("ecounts", f"""
        SELECT l.topic_label, e.text AS term, CAST(sum({_EVAL_CASE.replace('field', 'e.field')}) AS BIGINT) AS n
        FROM article_labels l JOIN entities_long e ON e.article_uid = l.article_uid
        WHERE coalesce(e.type, 'COMMON') NOT IN ('NUMBER', 'COMMON') AND NOT contains(lower(e.text), 'bild')
        GROUP BY l.topic_label, e.text"""),
    ("eranked", "SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY n DESC, term) AS rk FROM ecounts")],
    """SELECT topic_label, string_agg(term, ' | ' ORDER BY rk) AS top_words FROM eranked WHERE rk <= 8
       GROUP BY topic_label"""))
def q_top_entities(spark, base):
    labels = FX.article_labels(spark, base)
    ents = E.parse_entities(FX.entities(spark, base), form="name")
    ents = ents.withColumn("type", E.default_type(F.col("type")))
    ents = E.filter_entities(ents, dropped_types=["NUMBER", "COMMON"])
    ents = E.weight_entities(ents, E.EVAL_WEIGHTS).withColumnRenamed("text", "term")
    counts = tfidf.term_counts(labels.join(ents, "article_uid"))
    top = tfidf.top_terms(counts, 8, score="n")
    return tfidf.join_ranked(top, sep=" | ").withColumnRenamed("words", "top_words")


@register("topic_sizes", with_views(["article_labels", "articles"], select="""
    SELECT l.topic_label, count(a.seo_title) AS topic_size
    FROM article_labels l LEFT JOIN articles a ON a.article_uid = l.article_uid GROUP BY l.topic_label"""))
def q_topic_sizes(spark, base):
    """A1: articles with a (non-null) title per topic."""
    titles = FX.articles(spark, base).select("article_uid", "seo_title")
    return topics.topic_sizes(FX.article_labels(spark, base).join(titles, "article_uid", "left"), key="seo_title")


@register("cluster_summary", with_views(["article_labels"], select="""
    SELECT CAST(count(*) FILTER (WHERE topic_label = -1) AS BIGINT) AS outliers,
           CAST(count(*) FILTER (WHERE topic_label <> -1) AS BIGINT) AS clustered,
           round(CAST(count(*) FILTER (WHERE topic_label <> -1) AS DOUBLE) / count(*), 6) AS clustered_ratio,
           CAST(count(DISTINCT topic_label) FILTER (WHERE topic_label <> -1) AS BIGINT) AS n_clusters
    FROM article_labels"""))
def q_cluster_summary(spark, base):
    return topics.cluster_summary(FX.article_labels(spark, base))


# Entities by their simple form (name; brand word dropped, no type rule),
# weighted text 1, kicker 2, title 3; vectoriser tokens without stopwords, 1-2-grams
# inside each entity text; legacy c-TF-IDF; 10 best joined by " | ", with topic sizes.
def _d5_spark(spark, base):
    from tessera.functions import text as TX

    labels = FX.article_labels(spark, base)
    ents = E.weight_entities(E.parse_entities(FX.entities(spark, base), form="name"), E.PRESENTATION_WEIGHTS)
    toks = ents.select("article_uid", "weight", TX.remove_stopwords(TX.vectorizer_tokens("text")).alias("t"))
    grams = toks.select("article_uid", "weight", F.explode(TX.ngrams_upto(F.col("t"), 2)).alias("term"))
    counts = tfidf.term_counts(labels.join(grams, "article_uid"))
    top = tfidf.top_terms(tfidf.ctfidf_legacy(counts, labels.agg(F.count(F.lit(1)))), 10)
    words = tfidf.join_ranked(top, sep=" | ")
    return (topics.topic_sizes(labels).join(words, "topic_label", "left")
            .select("topic_label", F.coalesce("words", F.lit("")).alias("topic_desc"), "topic_size"))


def _d5_sql():
    from tessera.functions import text as TX
    from tessera.plans import sqltext as SQ

    w = "CASE e.field " + " ".join(f"WHEN '{f}' THEN {v}" for f, v in E.PRESENTATION_WEIGHTS.items()) + " END"
    return with_views(["article_labels", "entities_long"], [
        ("dtoks", f"""
            SELECT e.article_uid, {w} AS weight,
                   list_filter(regexp_extract_all(lower(e.text), '{TX.WORD}{{2,}}'),
                               lambda x: NOT list_contains({SQ.str_list(TX.stopwords())}, x)) AS t
            FROM entities_long e WHERE NOT contains(lower(e.text), 'bild')"""),
        ("dgrams", """
            SELECT article_uid, weight, unnest(list_concat(t, list_transform(range(1, len(t)),
                     lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM dtoks"""),
        ("dcounts", """
            SELECT l.topic_label, g.term, CAST(sum(g.weight) AS BIGINT) AS n
            FROM article_labels l JOIN dgrams g ON g.article_uid = l.article_uid GROUP BY l.topic_label, g.term"""),
        ("dscored", """
            SELECT c.topic_label, c.term,
                   (CAST(c.n AS DOUBLE) / r.row_total)
                   * ln(CAST((SELECT count(*) FROM article_labels) AS DOUBLE) / t.term_total) AS score
            FROM dcounts c
            JOIN (SELECT term, sum(n) AS term_total FROM dcounts GROUP BY term) t ON t.term = c.term
            JOIN (SELECT topic_label, sum(n) AS row_total FROM dcounts GROUP BY topic_label) r
              ON r.topic_label = c.topic_label"""),
        ("dwords", """
            SELECT topic_label, string_agg(term, ' | ' ORDER BY rk) AS words FROM (
              SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY score DESC, term) AS rk FROM dscored)
            WHERE rk <= 10 GROUP BY topic_label"""),
    ], """SELECT s.topic_label, coalesce(w.words, '') AS topic_desc, s.topic_size FROM
            (SELECT topic_label, count(article_uid) AS topic_size FROM article_labels GROUP BY topic_label) s
          LEFT JOIN dwords w USING (topic_label)""")


register("summarize_entities", _d5_sql)(_d5_spark)
