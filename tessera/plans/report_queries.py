"""Relational and reporting queries: S5, S6, J1-J7, A3-A9, P7-P13, Q1-Q5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import relational as R
from tessera.operators import topics
from tessera.plans import sqltext as SQ
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import fixtures as FX
from tessera.sources.tables import by_ids, latest, parse_day_first, read_table, deal

# Parameters of the registered report queries.
LATEST_N = 100
NEW_WINDOW = 500
TOPIC = 3
RANGE = ("2024-01-01", "2024-01-01")
SINCE = "2024-01-01 12:00:00"
PURCHASE = "purchase"


def topic_articles(spark, base):
    """Articles with their topic, title and date; outliers excluded."""
    labels = FX.article_labels(spark, base).filter(F.col("topic_label") != -1)
    return labels.join(FX.articles(spark, base).select("article_uid", F.col("headline").alias("title"), "created_at"), "article_uid")


def topic_page_views(spark, base, described: bool = True):
    """The dashboard's per-article table: topic, title, date and page views (missing -> 0); outliers
    excluded.  Its description and size are worked out only where ``described`` (every topic has one)."""
    t = topic_articles(spark, base)
    if described:
        t = t.join(topics.describe_topics(FX.article_labels(spark, base), FX.entities(spark, base)), "topic_label")
    return (t.join(FX.page_views(spark, base), "article_uid", "left")
            .withColumn("PageViews", F.coalesce(F.col("PageViews"), F.lit(0)).cast("bigint")))


@register("latest_n", with_views(["articles"], select=f"""
    SELECT article_uid, created_at, headline FROM articles
    ORDER BY created_at DESC NULLS LAST, article_uid LIMIT {LATEST_N}"""))
def q_latest_n(spark, base):
    """The newest articles (the limit is the operator)."""
    return latest(FX.articles(spark, base), LATEST_N).select("article_uid", "created_at", "headline")


@register("by_ids", with_views(["articles", "article_labels"], select=f"""
    SELECT article_uid, headline FROM articles
    WHERE article_uid IN (SELECT article_uid FROM article_labels WHERE topic_label = {TOPIC})"""))
def q_by_ids(spark, base):
    """Articles whose key is in another table's key list (left semi join)."""
    ids = FX.article_labels(spark, base).filter(F.col("topic_label") == TOPIC).select("article_uid")
    return by_ids(FX.articles(spark, base), ids).select("article_uid", "headline")


@register("new_articles", with_views(["articles"], select=f"""
    SELECT article_uid, created_at FROM (
      SELECT article_uid, created_at FROM articles
      ORDER BY created_at DESC NULLS LAST, article_uid LIMIT {NEW_WINDOW}) a
    WHERE article_uid NOT IN (SELECT vec_id FROM embeddings)"""))
def q_new_articles(spark, base):
    """Newest window of articles minus those that already have a vector."""
    done = read_table(spark, base, "embeddings", ["vec_id"]).withColumnRenamed("vec_id", "article_uid")
    src = FX.articles(spark, base).select("article_uid", "created_at")
    return R.new_articles(src, done, NEW_WINDOW)


@register("dedup_key", with_views(["articles"], select="""
    SELECT content_key, min(article_uid) AS article_uid, arg_min(headline, article_uid) AS headline
    FROM articles GROUP BY content_key"""))
def q_dedup_key(spark, base):
    """One article per content hash, the first by key."""
    art = FX.articles(spark, base).select("content_key", "article_uid", "headline")
    return R.dedup_by_key(art, "content_key")


@register("clip_to", with_views(["articles"], select=f"""
    SELECT article_uid, created_at FROM articles
    WHERE created_at > (SELECT min(ts) FROM events WHERE event_type = '{PURCHASE}')
      AND created_at < (SELECT max(ts) FROM events WHERE event_type = '{PURCHASE}')"""))
def q_clip_to(spark, base):
    """Articles strictly inside the time span of the purchase events."""
    ev = read_table(spark, base, "events", ["ts", "event_type"]).filter(F.col("event_type") == PURCHASE)
    art = FX.articles(spark, base).select("article_uid", "created_at")
    return R.clip_to(art, ev, "created_at", "ts")


@register("comment_counts", with_views(["articles", "posts"], select="""
    SELECT a.article_uid AS ID_Article, a.headline AS Title, a.created_at AS publishingDate, arts.comments
    FROM articles a LEFT JOIN (SELECT ID_Article, count(*) AS comments FROM posts
                               WHERE Status != 'deleted' GROUP BY ID_Article) arts
      ON a.article_uid = arts.ID_Article"""))
def q_comment_counts(spark, base):
    """The comment-count SQL of the reference as a DataFrame plan."""
    art = FX.articles(spark, base).select(F.col("article_uid").alias("ID_Article"), F.col("headline").alias("Title"),
                                          F.col("created_at").alias("publishingDate"))
    return R.comment_counts(art, FX.posts(spark, base))


@register("topic_day_counts", with_views(["articles", "article_labels"], select="""
    SELECT CAST(a.created_at AS DATE) AS date, l.topic_label, count(*) AS n
    FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid GROUP BY 1, 2"""))
def q_topic_day_counts(spark, base):
    """A3: topic x day counts (long form of the cross-tab)."""
    df = FX.article_labels(spark, base).join(FX.articles(spark, base), "article_uid")
    return R.topic_day_counts(df)


@register("category_counts", with_views(["articles"], select="""
    SELECT department, count(*) AS n FROM articles GROUP BY department"""))
def q_category_counts(spark, base):
    """A4: articles per department."""
    return R.count_per(FX.articles(spark, base), "department")


@register("daily_volume", """
    WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1)
    SELECT date, n, round((SELECT avg(n) FROM d), 6) AS mean_n FROM d""")
def q_daily_volume(spark, base):
    """A5: events per day and the mean daily count."""
    return R.daily_volume(read_table(spark, base, "events", ["ts"]), "ts")


def _stats_sql():
    tok = f"len(regexp_extract_all(text, {SQ.sql_str(TX.WORD + '+|[^' + TX.WORD[1:-1] + TX.WS[1:-1] + ']')}))"
    marked = f"regexp_replace(text, {SQ.sql_str('([.!?])' + TX.WS + '+')}, {SQ.sql_str(chr(92) + '1' + TX.SENTENCE_MARK)}, 'g')"
    sen = (f"len(list_filter(list_transform(string_split({marked}, {SQ.sql_str(TX.SENTENCE_MARK)}), "
           f"lambda x: {SQ.strip_ws('x')}), lambda x: x <> ''))")
    words = f"len({SQ.ws_split('text')})"
    parts = []
    for stat, fn in (("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "CAST(min({}) AS DOUBLE)"),
                     ("25%", "quantile_cont({}, 0.25)"), ("50%", "quantile_cont({}, 0.5)"),
                     ("75%", "quantile_cont({}, 0.75)"), ("max", "CAST(max({}) AS DOUBLE)")):
        cols = ", ".join(f"round({fn.format(m)}, 6) AS {m}" for m in ("tokens", "sentences", "words"))
        parts.append(f"SELECT '{stat}' AS stat, {cols} FROM per")
    return (f"WITH per AS (SELECT {tok} AS tokens, {sen} AS sentences, {words} AS words FROM documents)\n"
            + "\nUNION ALL ".join(parts))


@register("text_stats", _stats_sql())
def q_text_stats(spark, base):
    """describe() of tokens, sentences and words per document."""
    return R.text_stats(deal(read_table(spark, base, "documents", ["doc_id", "text"]), "doc_id"))


_TPV = ["topic_page_views"]


@register("top_topics", with_views(_TPV, select=f"""
    SELECT topic_label, topic_desc, topic_size, PageViews, round(PageViews / topic_size, 6) AS views_per_article FROM (
      SELECT topic_label, topic_desc, topic_size, CAST(sum(PageViews) AS BIGINT) AS PageViews
      FROM topic_page_views
      WHERE topic_label IN (SELECT topic_label FROM topic_page_views
                            WHERE CAST(created_at AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}')
      GROUP BY topic_label, topic_desc, topic_size)
    ORDER BY PageViews DESC, topic_label LIMIT 20"""))
def q_top_topics(spark, base):
    """Q1: top topics by page views for a date range."""
    return R.top_topics(topic_page_views(spark, base), *RANGE)


@register("topic_articles", with_views(_TPV, select=f"""
    SELECT topic_label, article_uid, title, created_at, PageViews FROM topic_page_views
    WHERE topic_label = {TOPIC} ORDER BY created_at DESC, article_uid LIMIT 10"""))
def q_topic_articles(spark, base):
    """Q2: ten articles of one topic."""
    return R.topic_articles(topic_page_views(spark, base, described=False), TOPIC)


@register("word_weights", with_views(["topic_table"], select="""
    SELECT topic_label, word, CAST(L - pos AS INTEGER) AS weight FROM (
      SELECT topic_label, len(w) AS L, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
        SELECT topic_label, string_split(replace(replace(topic_desc, '[''', ''), ''']', ''), ', ') AS w
        FROM topic_table))
    WHERE L - pos > 0"""))
def q_word_weights(spark, base):
    """Q3: description words with rank weights."""
    desc = topics.describe_topics(FX.article_labels(spark, base), FX.entities(spark, base))
    return R.word_weights(desc)


@register("since", with_views(_TPV, select=f"""
    SELECT article_uid, topic_label, created_at FROM topic_page_views
    WHERE created_at > TIMESTAMP '{SINCE}'"""))
def q_since(spark, base):
    """Q4: articles after a start date."""
    return R.since(topic_articles(spark, base), SINCE).select("article_uid", "topic_label", "created_at")


@register("topic_points", with_views(_TPV, select="""
    SELECT t.topic_label, t.article_uid, t.title, t.created_at, g.count_in_group
    FROM topic_page_views t JOIN (SELECT topic_label, count(*) AS count_in_group FROM topic_page_views
                                  GROUP BY topic_label) g USING (topic_label)"""))
def q_topic_points(spark, base):
    """Q5: scatter input, each article with the size of its topic."""
    return R.count_in_group(topic_articles(spark, base)).select("topic_label", "article_uid", "title", "created_at", "count_in_group")


@register("fill_title", with_views(["pairs"], select="""
    SELECT article_uid, CAST(coalesce(nullif(seo_title, ''), headline) AS VARCHAR) AS seo_title FROM pairs"""))
def q_fill_title(spark, base):
    """Title falls back to the headline when missing or empty."""
    return R.fill_title(FX.pairs(spark, base)).select("article_uid", "seo_title")


@register("dropna", with_views(["pairs"], select="""
    SELECT article_uid, headline, seo_title FROM pairs
    WHERE article_uid IS NOT NULL AND headline IS NOT NULL AND seo_title IS NOT NULL"""))
def q_dropna(spark, base):
    """Rows with any null dropped."""
    return FX.pairs(spark, base).na.drop("any")


@register("date_parts", with_views(["articles"], select="""
    SELECT article_uid, strftime(created_at, '%Y-%m-%d') AS day,
           CAST(floor(epoch_us(created_at) / 1000000) AS BIGINT) AS epoch,
           strftime(created_at, '%d/%m/%Y %H:%M:%S') AS day_first,
           date_trunc('second', created_at) AS reparsed
    FROM articles"""))
def q_date_parts(spark, base):
    """Date text, unix seconds, day-first text and its re-parse (S1 formats)."""
    art = FX.articles(spark, base)
    df = art.select("article_uid", R.to_date_text(F.col("created_at")).alias("day"),
                    R.epoch_seconds(F.col("created_at")).alias("epoch"),
                    F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("day_first"))
    return df.withColumn("reparsed", parse_day_first("day_first").cast("timestamp_ntz"))


@register("filters", with_views(["articles"], select="""
    SELECT article_uid, department FROM articles
    WHERE department <> 'src0' AND created_at > TIMESTAMP '2024-01-01 12:00:00'"""))
def q_filters(spark, base):
    """Comparison filters pushed into the scan."""
    art = FX.articles(spark, base)
    return art.filter((F.col("department") != "src0") & (F.col("created_at") > F.lit("2024-01-01 12:00:00").cast("timestamp")))\
              .select("article_uid", "department")


@register("date_range", with_views(["articles"], select="""
    SELECT min(created_at) AS first_at, max(created_at) AS last_at FROM articles"""))
def q_date_range(spark, base):
    """Min / max of a column."""
    return FX.articles(spark, base).agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@register("distinct_counts", with_views(["articles", "article_labels"], select="""
    SELECT (SELECT count(DISTINCT department) FROM articles) AS departments,
           (SELECT count(DISTINCT topic_label) FROM article_labels) AS topics"""))
def q_distinct_counts(spark, base):
    """Distinct counts as scalar subqueries."""
    dep = FX.articles(spark, base).agg(F.count_distinct("department")).scalar()
    top = FX.article_labels(spark, base).agg(F.count_distinct("topic_label")).scalar()
    return spark.range(1).select(dep.cast("bigint").alias("departments"), top.cast("bigint").alias("topics"))


@register("article_topics", with_views(["articles", "article_labels", "topic_table"], select="""
    SELECT a.article_uid, l.topic_label, t.topic_desc, t.topic_size
    FROM articles a LEFT JOIN article_labels l ON l.article_uid = a.article_uid
    LEFT JOIN topic_table t ON t.topic_label = l.topic_label"""))
def q_article_topics(spark, base):
    """Articles with their topic, description and size (left joins)."""
    art = FX.articles(spark, base).select("article_uid")
    labels = FX.article_labels(spark, base)
    desc = topics.describe_topics(labels, FX.entities(spark, base))
    return art.join(labels, "article_uid", "left").join(desc, "topic_label", "left")\
              .select("article_uid", "topic_label", "topic_desc", "topic_size")


@register("link_topics", with_views(["articles", "article_labels"], select="""
    SELECT l.article_uid, l.topic_label, a.seo_title AS headline, a.headline AS seo_title, a.text,
           strftime(a.created_at, '%Y-%m-%d') AS created_at
    FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid"""))
def q_link_topics(spark, base):
    """Labels aligned with article columns by key (the reference zips by
    position), keeping its headline / seo_title swap and the date as text."""
    return topics.link_topics(FX.article_labels(spark, base), FX.articles(spark, base), swap_titles=True)


# Topic labels of the label view: 0..8 and -1 (label 9 is the outlier topic).
PIVOT_TOPICS = [-1] + list(range(0, FX.OUTLIER_TOPIC))


@register("topic_day_matrix", with_views(["articles", "article_labels"], select=f"""
    SELECT CAST(a.created_at AS DATE) AS date,
           {", ".join(f'count(*) FILTER (WHERE l.topic_label = {t}) AS "{t}"' for t in PIVOT_TOPICS)}
    FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid GROUP BY 1"""))
def q_topic_day_matrix(spark, base):
    """A3: date x topic cross-tab (pivot over the given topic list, missing cells 0)."""
    df = FX.article_labels(spark, base).join(FX.articles(spark, base), "article_uid")
    return R.topic_day_matrix(df, PIVOT_TOPICS)
