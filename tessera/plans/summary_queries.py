"""Graph-ranked topic summaries: D7 topic_abstract, D8 topic_keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import embed as EM
from tessera.operators import summaries as SM
from tessera.plans import sqltext as SQ
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import hold
from tessera.sources import fixtures as FX


def _labelled_articles(spark, base):
    labels = FX.article_labels(spark, base)
    art = FX.articles(spark, base).select("article_uid", "text", "created_at")
    return labels.join(art, "article_uid")


@register("topic_keywords")
def q_topic_keywords(spark, base):
    """PageRank keywords per topic over word co-occurrence; topic -1 -> ' NONE '."""
    la = _labelled_articles(spark, base)
    toks = la.filter(F.col("topic_label") != -1).select("topic_label", TX.tokens("text").alias("t"))
    kw = SM.topic_keywords(toks)
    none = spark.createDataFrame([(-1, 1, SM.NONE_TOPIC_TEXT, None)],
                                 "topic_label int, rank int, word string, score double")
    return kw.unionByName(none)


@register("topic_abstract")
def q_topic_abstract(spark, base):
    """Most central sentence per topic (stationary distribution of the
    (1+cos)/2 sentence walk, from per-topic sums, no pairs); topic -1 -> ' NONE '."""
    la = _labelled_articles(spark, base).filter(F.col("topic_label") != -1)
    sent = la.select("topic_label", "article_uid", F.posexplode(TX.sentences("text")).alias("pos", "sentence"))
    sent = sent.filter(F.col("sentence") != "").withColumn("sid", F.concat_ws(":", "article_uid", "pos"))
    sent = hold(sent, "sentences")  # cut once, read for the encoder, its terms and the sentences themselves
    vec = EM.embed(sent.select("sid", F.col("sentence").alias("text")), key="sid")
    s = hold(sent.join(vec, "sid"), "vectors")  # (read for the sums and for the scores: encoded once)
    best = SM.topic_abstract(s, key="sid", order=("article_uid", "pos"))
    none = spark.createDataFrame([(-1, SM.NONE_TOPIC_TEXT, None)], "topic_label int, sentence string, score double")
    return best.unionByName(none)


def _central_sql():
    return with_views(["article_labels", "articles"], [
        ("cut", f"""
            SELECT l.topic_label, a.article_uid, {SQ.sentences('a.text')} AS s
            FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid WHERE l.topic_label <> -1"""),
        ("sent", """
            SELECT *, row_number() OVER (ORDER BY article_uid, pos) AS sid FROM (
              SELECT topic_label, article_uid, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM cut)
            WHERE sentence <> ''"""),
        ("tf", f"""
            SELECT topic_label, sid, term, CAST(count(*) AS DOUBLE) AS tf FROM (
              SELECT topic_label, sid, unnest(regexp_extract_all(lower(sentence), '{TX.WORD}{{2,}}')) AS term FROM sent)
            GROUP BY topic_label, sid, term"""),
        ("idf", """
            SELECT term, ln(CAST((SELECT count(*) FROM sent) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS idf
            FROM tf GROUP BY term"""),
        ("w", "SELECT topic_label, sid, term, tf * idf AS w FROM tf JOIN idf USING (term)"),
        ("len", "SELECT sid, sqrt(sum(w * w)) AS len FROM w GROUP BY sid"),
        ("x", "SELECT topic_label, sid, term, w / len AS x FROM w JOIN len USING (sid)"),
        ("s", "SELECT topic_label, term, sum(x) AS s FROM x GROUP BY topic_label, term"),
        ("deg", "SELECT topic_label, sid, sum(x * s) AS d FROM x JOIN s USING (topic_label, term) GROUP BY topic_label, sid"),
        ("labs", """
            SELECT 0 AS r, sid, sid AS lab, true AS moved FROM deg
            UNION ALL
            SELECT l.r + 1, l.sid, m.lab, bool_or(m.lab <> l.lab) OVER () FROM labs l JOIN (
              SELECT x.sid, min(t.lab) AS lab FROM x JOIN (
                SELECT x.topic_label, x.term, min(k.lab) AS lab FROM labs k JOIN x ON x.sid = k.sid
                GROUP BY x.topic_label, x.term) t ON t.topic_label = x.topic_label AND t.term = x.term
              GROUP BY x.sid) m ON m.sid = l.sid
            WHERE l.moved"""),
        ("part", """
            SELECT d.topic_label, d.sid, d.d, l.lab FROM deg d JOIN labs l ON l.sid = d.sid
            WHERE l.r = (SELECT max(r) FROM labs)"""),
        ("v", """
            SELECT topic_label, sid, d / sum(d) OVER (PARTITION BY topic_label, lab)
                   * count(*) OVER (PARTITION BY topic_label, lab) / count(*) OVER (PARTITION BY topic_label) AS v FROM part"""),
    ], f"""
        SELECT topic_label, sentence, score FROM (
          SELECT v.topic_label, sentence, round(v, 6) AS score,
                 row_number() OVER (PARTITION BY v.topic_label ORDER BY round(v, 12) DESC, v.sid) AS rk
          FROM v JOIN sent USING (sid)) WHERE rk = 1
        UNION ALL SELECT -1, '{SM.NONE_TOPIC_TEXT}', NULL""", recursive=True)


@register("topic_abstract_cosine", _central_sql)
def q_topic_abstract_cosine(spark, base):
    """D7 by cosine of TF-IDF sentences: the walk's exact limit; topic -1 -> ' NONE '."""
    la = _labelled_articles(spark, base).filter(F.col("topic_label") != -1)
    sent = la.select("topic_label", "article_uid", F.posexplode(TX.sentences("text")).alias("pos", "sentence"))
    sent = hold(sent.filter(F.col("sentence") != "").withColumn("sid", F.xxhash64("article_uid", "pos")), "sentences")
    best = SM.central_sentence(sent, order=("article_uid", "pos"))
    none = spark.createDataFrame([(-1, SM.NONE_TOPIC_TEXT, None)], "topic_label int, sentence string, score double")
    return best.unionByName(none)
