"""Relational operators of the flows and reports.

Skew rules applied throughout: per-group results are computed with partial
aggregates (``groupBy`` / ``min_by``), never with a window over a whole group,
and scalars (min, max, mean) are scalar subqueries (``DataFrame.scalar()``),
never a join against a one-row table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.sources.tables import latest


def new_articles(src: DataFrame, done: DataFrame, n: int | None = 1000, key: str = "article_uid",
                 ts: str = "created_at") -> DataFrame:
    """Latest ``n`` source rows minus keys already processed (limit first,
    then anti join, as the reference does)."""
    return latest(src, n, ts, key).join(done.select(key), key, "left_anti")


def dedup_by_key(df: DataFrame, keys, order: str = "article_uid") -> DataFrame:
    """One row per key value, the one with the least ``order`` value.

    ``min_by`` is a partial aggregate, so a key holding a third of all rows is
    reduced map-side instead of landing whole in one window task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def clip_to(df: DataFrame, other: DataFrame, ts: str, other_ts: str) -> DataFrame:
    """Rows strictly between min and max of ``other_ts`` in ``other``."""
    lo = other.agg(F.min(other_ts)).scalar()
    hi = other.agg(F.max(other_ts)).scalar()
    return df.filter((F.col(ts) > lo) & (F.col(ts) < hi))


def comment_counts(articles: DataFrame, posts: DataFrame, key: str = "ID_Article",
                   status: str = "Status") -> DataFrame:
    """Comments per article that are not deleted; articles without any keep null."""
    counts = (posts.filter(F.col(status) != "deleted").groupBy(key)
              .agg(F.count(F.lit(1)).alias("comments")))
    return articles.join(counts, key, "left")


def count_per(df: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Rows per value (partial aggregate)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("bigint").alias(name))


def daily_volume(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """A5: rows per date and the mean of the daily counts (scalar subquery)."""
    daily = count_per(df.select(F.to_date(ts).alias("date")), "date")
    mean = daily.agg(F.avg("n")).scalar()
    return daily.withColumn("mean_n", F.round(mean, 6))


def topic_day_counts(df: DataFrame, topic: str = "topic_label", ts: str = "created_at") -> DataFrame:
    """A3 in long form: (date, topic, n); ``topic_day_matrix`` pivots it."""
    return count_per(df.select(F.to_date(ts).alias("date"), topic), "date", topic)


def topic_day_matrix(df: DataFrame, topics: list, topic: str = "topic_label",
                     ts: str = "created_at") -> DataFrame:
    """A3: date x topic cross-tab; the topic list is given (no driver-side
    distinct), missing cells are 0."""
    wide = (df.select(F.to_date(ts).alias("date"), topic).groupBy("date")
            .pivot(topic, topics).count())
    return wide.na.fill(0)


def text_measures(text: Column) -> dict[str, Column]:
    """Per-text counts used by ``text_stats``: tokens (word and symbol pieces),
    sentences (F2 splitter) and words (whitespace tokens)."""
    return {
        "tokens": F.size(F.regexp_extract_all(text, F.lit(TX.WORD + "+|[^" + TX.WORD[1:-1] + TX.WS[1:-1] + "]"), 0)),
        "sentences": F.size(TX.sentences_lang(text)),
        "words": F.size(TX.ws_split(text)),
    }


STATS = ("mean", "std", "min", "25%", "50%", "75%", "max")


def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """describe() of tokens, sentences and words per text, one row per
    statistic and one column per measure.  All statistics come from the histogram
    of each measure (one row per distinct count); percentiles are exact (linear
    interpolation between the two ranks, found by cumulative counts)."""
    m = text_measures(F.col(text))
    per = df.select(*[v.cast("long").alias(k) for k, v in m.items()]).unpivot([], list(m), "measure", "v")
    hist = per.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("measure").orderBy("v")
    whole = Window.partitionBy("measure")
    hist = hist.select("measure", F.col("v").cast("double").alias("v"), "c", F.sum("c").over(upto).alias("upto"),
                       F.sum("c").over(whole).alias("n"))
    n, total, square = F.sum("c"), F.sum(F.col("c") * F.col("v")), F.sum(F.col("c") * F.col("v") * F.col("v"))
    aggs = [(total / n).alias("mean"), F.when(n > 1, F.sqrt((square - total * total / n) / (n - 1))).alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max")]
    for p in (25, 50, 75):
        at = (F.col("n") - 1) * F.lit(p / 100)
        low, high = (F.min(F.when(F.col("upto") > f(at), F.col("v"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(f"{p}%"))
    one = hist.groupBy("measure").agg(*aggs).unpivot(["measure"], list(STATS), "stat", "value")
    return (one.groupBy("stat").pivot("measure", list(m)).agg(F.first(F.round("value", 6)))
            .select("stat", *m))


def fill_title(df: DataFrame, title: str = "seo_title", fallback: str = "headline") -> DataFrame:
    """Empty or null title -> fallback, as string."""
    return df.withColumn(title, F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(fallback)).cast("string"))


def fill_latest(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """P10: missing timestamps -> the latest one in the table (scalar subquery)."""
    return df.withColumn(ts, F.coalesce(F.col(ts), df.agg(F.max(ts)).scalar()))


def count_in_group(df: DataFrame, topic: str = "topic_label", name: str = "count_in_group") -> DataFrame:
    """Per-row size of its group: aggregate + join (the per-topic table is as
    small as the number of topics; AQE broadcasts it when it is), so a hot
    topic is never buffered whole by one window task."""
    return df.join(count_per(df, topic, name=name), topic)


def _as_date(v) -> Column:
    return F.to_date(F.lit(str(v)))


def top_topics(table: DataFrame, start=None, end=None, n: int = 20, topic: str = "topic_label",
               ts: str = "created_at") -> DataFrame:
    """Q1: topics with any article in the date range, page views summed over
    all their articles, best ``n``; both bounds inclusive, a single bound
    exclusive, none -> all.  One partial aggregate, no semi join."""
    d = F.to_date(ts)
    if start and end:
        hit = (d >= _as_date(start)) & (d <= _as_date(end))
    elif start:
        hit = d > _as_date(start)
    elif end:
        hit = d < _as_date(end)
    else:
        hit = F.lit(True)
    agg = (table.groupBy(topic, "topic_desc", "topic_size")
           .agg(F.sum("PageViews").cast("bigint").alias("PageViews"), F.max(hit.cast("int")).alias("_hit"))
           .filter(F.col("_hit") == 1).drop("_hit"))
    top = agg.orderBy(F.col("PageViews").desc(), F.col(topic)).limit(n)
    return top.withColumn("views_per_article", F.round(F.col("PageViews") / F.col("topic_size"), 6))


def topic_articles(table: DataFrame, label: int, n: int = 10, topic: str = "topic_label") -> DataFrame:
    """Q2: first ``n`` articles of one topic (newest first, key breaks ties)."""
    return (table.filter(F.col(topic) == label)
            .select(topic, "article_uid", "title", "created_at", "PageViews")
            .orderBy(F.col("created_at").desc(), "article_uid").limit(n))


def word_weights(desc: DataFrame, topic: str = "topic_label", col: str = "topic_desc") -> DataFrame:
    """Q3: description words weighted len-1 ... 1; the last word gets none."""
    from tessera.functions.entities import description_words

    w = desc.select(topic, description_words(F.col(col)).alias("w"))
    ex = w.select(topic, F.size("w").alias("L"), F.posexplode("w").alias("pos", "word"))
    return (ex.withColumn("weight", (F.col("L") - F.col("pos") - 1).cast("int"))
            .filter(F.col("weight") > 0).select(topic, "word", "weight"))


def since(df: DataFrame, start=None, ts: str = "created_at") -> DataFrame:
    """Q4: rows after ``start`` (all when None)."""
    if not start:
        return df
    return df.filter(F.col(ts) > F.lit(start).cast("timestamp"))


def to_date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds of a zone-less timestamp (as the reference's ns // 1e9)."""
    return F.unix_timestamp(ts.cast("timestamp"))


def hash_share(key: Column, seed: int) -> Column:
    """A number from 0 to 99 for each key, the same on every run, engine and partitioning: eight hexadecimal
    digits of md5(``<seed>:<key>``) modulo 100."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_rows(df: DataFrame, key: str, test_percent: int = 20, seed: int = 1) -> DataFrame:
    """``split`` is ``test`` for about ``test_percent`` of the keys, else ``train``; rows of one key stay
    together, and a null key is for training."""
    test = F.coalesce(hash_share(F.col(key), seed) < test_percent, F.lit(False))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))
