"""Text queries: P1-P5, P15, F1, F3, F5, F7 over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.plans import sqltext as SQ
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import fixtures as FX
from tessera.sources.tables import read_table, deal


def _docs(spark, base):
    return deal(read_table(spark, base, "documents", ["doc_id", "text"]), "doc_id")


@register("clean_article", f"SELECT doc_id, {SQ.clean_article('text')} AS cleaned FROM documents")
def q_clean_article(spark, base):
    return _docs(spark, base).select("doc_id", TX.clean_article("text").alias("cleaned"))


@register("clean_hard", f"SELECT doc_id, {SQ.clean_hard('text')} AS cleaned FROM documents")
def q_clean_hard(spark, base):
    return _docs(spark, base).select("doc_id", TX.clean_hard("text").alias("cleaned"))


@register("strip_title", with_views(["articles"], select=f"""
    SELECT article_uid, {SQ.strip_title('seo_title')} AS title,
           {SQ.strip_title('seo_title', True)} AS title_no_section FROM articles"""))
def q_strip_title(spark, base):
    art = FX.articles(spark, base)
    return art.select("article_uid", TX.strip_title("seo_title").alias("title"),
                      TX.strip_title("seo_title", True).alias("title_no_section"))


@register("compose_text", with_views(["articles"], select=f"""
    SELECT article_uid, {SQ.clean_article(SQ.strip_title('seo_title', True) + " || '. ' || text")} AS composed
    FROM articles"""))
def q_compose_text(spark, base):
    art = FX.articles(spark, base)
    return art.select("article_uid", TX.compose_text("seo_title", "text").alias("composed"))


_PUNCT_SQL = SQ.sql_str(TX.char_class(TX.ASCII_PUNCTUATION))


@register("mix", with_views(["articles"], select=f"""
    SELECT article_uid, headline || ' ' || {SQ.first_words('text', 150)} AS mix,
           regexp_replace(lower(headline) || ' ' || {SQ.strip_title('seo_title')}, {_PUNCT_SQL}, '', 'g') AS mix_title
    FROM articles"""))
def q_mix(spark, base):
    art = FX.articles(spark, base)
    return art.select("article_uid", TX.mix("headline", "text").alias("mix"),
                      TX.mix("headline", seo_title="seo_title", lower_strip=True).alias("mix_title"))


@register("sentences", f"""
    SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, sentence FROM (
      SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
      FROM (SELECT doc_id, {SQ.sentences('text')} AS s FROM documents))""")
def q_sentences(spark, base):
    d = _docs(spark, base)
    return (d.select("doc_id", F.posexplode(TX.sentences("text")).alias("pos", "sentence"))
            .withColumn("pos", F.col("pos").cast("bigint")))


@register("tokens", f"""
    SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, token FROM (
      SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
      FROM (SELECT doc_id, {SQ.tokens('text')} AS t FROM documents))""")
def q_tokens(spark, base):
    d = _docs(spark, base)
    return (d.select("doc_id", F.posexplode(TX.tokens("text")).alias("pos", "token"))
            .withColumn("pos", F.col("pos").cast("bigint")))


@register("stopwords_removed", f"""
    SELECT doc_id, array_to_string(list_filter({SQ.ws_split('lower(text)')},
                     lambda x: NOT list_contains({SQ.str_list(TX.stopwords())}, x)), ' ') AS kept
    FROM documents""")
def q_stopwords_removed(spark, base):
    d = _docs(spark, base)
    return d.select("doc_id", F.array_join(TX.remove_stopwords(TX.ws_split(F.lower("text"))), " ").alias("kept"))


@register("bigrams", f"""
    SELECT doc_id, gram, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram
      FROM (SELECT doc_id, {SQ.tokens('text')} AS t FROM documents))
    GROUP BY doc_id, gram""")
def q_bigrams(spark, base):
    d = _docs(spark, base)
    # tokens first as their own column: the n-gram lambda must read a value,
    # not re-run the token expression once per element
    def counts(part):
        t = part.select("doc_id", TX.tokens("text").alias("t"))
        g = t.select("doc_id", F.explode(TX.ngrams(F.col("t"), 2)).alias("gram"))
        return g.groupBy("doc_id", "gram").agg(F.count(F.lit(1)).cast("bigint").alias("n"))

    # texts are dealt by document, so their grams (several times the text) are counted where they are cut;
    # rows without an id have no document to be dealt by: there the counts are shuffled
    own = d.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").repartition("doc_id")
    return counts(own).unionByName(counts(d.filter(F.col("doc_id").isNull())))


@register("build_pairs", with_views(["pairs"], select=f"""
    SELECT article_uid, a AS headline, b AS title FROM (
      SELECT article_uid, {SQ.clean_hard('headline')} AS a, {SQ.clean_hard('seo_title')} AS b FROM pairs)
    WHERE length(a) > 3 AND length(b) > 3"""))
def q_build_pairs(spark, base):
    """Cleaned (headline, second line) pairs, both longer than 3 chars."""
    p = FX.pairs(spark, base).select("article_uid", TX.clean_hard("headline").alias("headline"),
                                     TX.clean_hard("seo_title").alias("title"))
    return p.filter((F.length("headline") > 3) & (F.length("title") > 3))
