"""Queries for the sources, sinks and small column rules: S1-S3, S8-S10, J4, P10, F2, F6, F9, F15, F18."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.functions import text as TX
from tessera.plans import sqltext as SQ
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import hold
from tessera.sources import fixtures as FX
from tessera.sources import tables as TB
from tessera.sources.tables import deal, read_table
from tessera.streaming.ingest import scratch

SCORE_AT_LEAST = 0.3


def _docs(spark, base):
    return deal(read_table(spark, base, "documents", ["doc_id", "text"]), "doc_id")


_MARKED = (f"regexp_replace(text, {SQ.sql_str('([.!?])' + TX.WS + '+')}, {SQ.sql_str(chr(92) + '1' + TX.SENTENCE_MARK)}, 'g')")


@register("sentences_lang", f"""
    SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, sentence FROM (
      SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (
        SELECT doc_id, list_filter(list_transform(string_split({_MARKED}, {SQ.sql_str(TX.SENTENCE_MARK)}),
                 lambda x: {SQ.strip_ws('x')}), lambda x: x <> '') AS s FROM documents))""")
def q_sentences_lang(spark, base):
    """sentences by end marks followed by blanks."""
    return (_docs(spark, base).select("doc_id", F.posexplode(TX.sentences_lang("text")).alias("pos", "sentence"))
            .withColumn("pos", F.col("pos").cast("bigint")))


def _stem_sql(x: str) -> str:
    low = f"lower({x})"
    for a, b in (("ß", "ss"), ("ä", "a"), ("ö", "o"), ("ü", "u")):
        low = f"replace({low}, '{a}', '{b}')"
    return f"regexp_replace({low}, '^(.{{3,}}?)({'|'.join(TX._STEM_SUFFIXES)})$', '\\1')"


@register("stems", lambda: f"""
    SELECT doc_id, array_to_string(list_transform({SQ.tokens('text')}, lambda x: {_stem_sql('x')}), ' ') AS stems
    FROM documents""")
def q_stems(spark, base):
    """the tokens of every document, lightly stemmed."""
    toks = _docs(spark, base).select("doc_id", TX.tokens("text").alias("t"))
    return toks.select("doc_id", F.array_join(F.transform("t", TX.light_stem), " ").alias("stems"))


@register("dedupe_keep_last", f"""
    WITH t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos
               FROM (SELECT doc_id, {SQ.ws_split('text')} AS w FROM documents)),
         l AS (SELECT doc_id, x, max(pos) AS pos FROM t GROUP BY doc_id, x)
    SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY pos), '') AS words
    FROM documents d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id""")
def q_dedupe_keep_last(spark, base):
    """each word of a document once, at its last place."""
    return _docs(spark, base).select("doc_id", F.array_join(E.dedupe_keep_last(TX.ws_split("text")), " ").alias("words"))


@register("entity_texts", with_views(["entity_tokens"], select="""
    SELECT article_uid, string_agg(text, ',' ORDER BY pos) AS names FROM entity_tokens
    WHERE field = 'text' GROUP BY article_uid"""))
def q_entity_texts(spark, base):
    """the entity names of every article body, in order."""
    arr = FX.entities(spark, base).select("article_uid", E.parse_entity_array(F.col("text")).alias("e"))
    names = arr.filter(F.size("e") > 0).select("article_uid", E.entity_texts(F.col("e")).alias("names"))
    return names.select("article_uid", F.array_join("names", ",").alias("names"))


@register("filter_score", with_views(["entities_long"], select=f"""
    SELECT article_uid, field, text, round(salience, 6) AS salience FROM entities_long WHERE salience > {SCORE_AT_LEAST}"""))
def q_filter_score(spark, base):
    """entities above a score."""
    ents = E.filter_score(E.parse_entities(FX.entities(spark, base)), "salience", SCORE_AT_LEAST)
    return ents.select("article_uid", "field", "text", F.round("salience", 6).alias("salience"))


@register("fill_latest", with_views(["articles"], [
    ("a", "SELECT article_uid, CASE WHEN is_premium THEN created_at END AS created_at FROM articles")],
    "SELECT article_uid, coalesce(created_at, (SELECT max(created_at) FROM a)) AS created_at FROM a"))
def q_fill_latest(spark, base):
    """P10: missing times become the latest time of the table."""
    from tessera.operators.relational import fill_latest

    art = FX.articles(spark, base).select("article_uid", F.when(F.col("is_premium"), F.col("created_at")).alias("created_at"))
    return fill_latest(art)


@register("right_join", with_views(["articles", "article_labels"], select="""
    SELECT l.article_uid, l.topic_label, a.headline
    FROM (SELECT * FROM articles WHERE is_premium) a RIGHT JOIN article_labels l ON a.article_uid = l.article_uid"""))
def q_right_join(spark, base):
    """Every label row, with the headline where the article is at hand."""
    art = FX.articles(spark, base).filter("is_premium").select("article_uid", "headline")
    return art.join(FX.article_labels(spark, base), "article_uid", "right").select("article_uid", "topic_label", "headline")


def _article_csv(spark, base):
    """The articles view written as CSV in the article layout; returns its folder."""
    path = scratch(spark, "articles-csv")
    a = FX.articles(spark, base)
    (a.select(F.col("article_uid").cast("string").alias("article_uid"), F.lit(None).cast("string").alias("cms_id"), "headline",
              "seo_title", "text", F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("created_at"), "department", "is_premium")
     .write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path))
    return path


_CSV_SQL = with_views(["articles"], select="""
    SELECT CAST(article_uid AS VARCHAR) AS article_uid, trim(headline) AS headline,
           date_trunc('second', created_at) AS created_at, is_premium FROM articles""")


@register("csv_articles", _CSV_SQL)
def q_csv_articles(spark, base):
    """The articles by way of a CSV file with header and day-first times."""
    df = TB.read_articles(spark, _article_csv(spark, base))
    return df.select("article_uid", F.trim("headline").alias("headline"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "is_premium")


@register("csv_skip_bad", _CSV_SQL)
def q_csv_skip_bad(spark, base):
    """The same file with a row of a malformed flag for every document added, read with malformed
    rows skipped: what is left is the reader's doing alone."""
    path = _article_csv(spark, base)
    text = lambda x: F.lit(x).cast("string")
    bad = read_table(spark, base, "documents", ["doc_id"]).select(
        F.col("doc_id").cast("string").alias("article_uid"), text(None).alias("cms_id"), text("h").alias("headline"), text("s").alias("seo_title"),
        text("t").alias("text"), text("01/01/2024 00:00:00").alias("created_at"), text("d").alias("department"), text("not-a-flag").alias("is_premium"))
    bad.write.option("header", True).option("quoteAll", True).mode("append").csv(path)
    df = TB.read_articles(spark, path, drop_malformed=True)
    # every column is asked for, so that every malformed row is seen as such
    whole = F.struct(*df.columns).alias("row")
    return (df.select(whole).select("row.*")
            .select("article_uid", F.trim("headline").alias("headline"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "is_premium"))


@register("csv_entities", with_views(["articles"], select="""
    SELECT CAST(article_uid AS VARCHAR) AS article_uid, length(text) AS n FROM articles"""))
def q_csv_entities(spark, base):
    """S3: a header-less CSV with given column names, keyed on the article."""
    path = scratch(spark, "entities-csv")
    a = FX.articles(spark, base)
    one = lambda c: F.lit(None).cast("string").alias(c)
    (a.select(one("_id"), F.col("article_uid").cast("string").alias("article_id"), one("kicker_headline"), "text", one("seo_title"),
              one("created_at_ne"), one("updated_at"), one("parset"))
     .write.option("escape", '"').option("quoteAll", True).csv(path))
    return TB.read_entities(spark, path).select("article_uid", F.length("text").cast("bigint").alias("n"))


@register("replace_table", with_views(["article_labels"], select="""
    SELECT article_uid, topic_label FROM article_labels WHERE topic_label >= 0"""))
def q_replace_table(spark, base):
    """A stored table replaced in one overwrite."""
    path = scratch(spark, "labels-table")
    labels = FX.article_labels(spark, base)
    TB.replace(labels, path)
    TB.replace(labels.filter("topic_label >= 0"), path)
    return spark.read.parquet(path)


@register("ensure_table", with_views(["article_labels"], select="""
    SELECT false AS before_first, true AS before_second, count(*) AS n FROM article_labels"""))
def q_ensure_table(spark, base):
    """A table created only where it is missing keeps what was written to it."""
    labels = FX.article_labels(spark, base)
    path = scratch(spark, "ensured")
    name = "tessera_ensured_" + path[-12:]
    first = TB.ensure_table(spark, name, labels.schema, path)
    labels.write.insertInto(name)
    second = TB.ensure_table(spark, name, labels.schema, path)
    out = hold(spark.table(name).agg(F.lit(first).alias("before_first"), F.lit(second).alias("before_second"),
                                     F.count(F.lit(1)).alias("n")), "ensured")
    spark.sql(f"DROP TABLE {name}")  # (the catalog keeps no table of a run)
    return out


@register("has_rows", with_views(["article_labels"], select="""
    SELECT count(*) FILTER (WHERE topic_label = 3) > 0 AS topic_3, count(*) FILTER (WHERE topic_label = 99) > 0 AS topic_99
    FROM article_labels"""))
def q_has_rows(spark, base):
    """Non-empty tests that read at most one row."""
    labels = FX.article_labels(spark, base)
    found = [TB.has_rows(labels.filter(F.col("topic_label") == k)) for k in (3, 99)]
    return labels.limit(1).select(F.lit(found[0]).alias("topic_3"), F.lit(found[1]).alias("topic_99"))
