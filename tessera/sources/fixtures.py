"""Views that map the shared test tables onto the reference's inputs.

The definitions follow FIXTURES.md part 2 and are written the same way in the
DuckDB oracle (``tessera.plans.oracle``).  Every view is lazy and derived from
the given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import deal, read_table

# Fixed values of the entity fixture (FIXTURES.md): token pattern and the entity type
# picked by ``length(token) % 5``.
ENTITY_TOKEN_PATTERN = "[A-Z][a-z]{3,}"
ENTITY_TYPES_BY_LENGTH_MOD_5 = ["PERSON", "LOCATION", "ORGANIZATION", "NUMBER", None]
SEO_SUFFIX = " - Bild.de"
OUTLIER_TOPIC = 9  # label mapped to -1 in ``article_labels`` (outlier rule)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def second_line(c: Column) -> Column:
    """Second line of a text, null when there is none."""
    return F.when(F.instr(c, "\n") > 0,
                  F.substring_index(F.substring_index(c, "\n", 2), "\n", -1))


def articles(spark: SparkSession, base: str) -> DataFrame:
    """``documents`` with the time and flag of ``events`` (``event_id = doc_id``); a
    document without an event keeps its row, with nulls."""
    docs = deal(read_table(spark, base, "documents", ["doc_id", "text", "source"]), "doc_id")
    ev = read_table(spark, base, "events", ["event_id", "ts", "value"])
    headline = first_line(F.col("text"))
    return (docs.join(ev, docs.doc_id == ev.event_id, "left")
            .select(F.col("doc_id").alias("article_uid"),
                    headline.alias("headline"),
                    F.concat(headline, F.lit(" - "), F.col("source"), F.lit(SEO_SUFFIX)).alias("seo_title"),
                    F.col("text"),
                    F.col("source").alias("department"),
                    F.col("ts").alias("created_at"),
                    (F.col("value") > 50).alias("is_premium"),
                    F.md5(F.col("text")).alias("content_key")))


def article_labels(spark: SparkSession, base: str, outlier_topic: int | None = OUTLIER_TOPIC) -> DataFrame:
    """``embeddings`` as a topic-label table; ``outlier_topic`` becomes -1."""
    emb = read_table(spark, base, "embeddings", ["vec_id", "label"])
    label = F.col("label")
    if outlier_topic is not None:
        label = F.when(label == outlier_topic, F.lit(-1)).otherwise(label)
    return emb.select(F.col("vec_id").alias("article_uid"), label.cast("int").alias("topic_label"))


def article_vectors(spark: SparkSession, base: str) -> DataFrame:
    """Articles that have a vector: ``article_uid, embedding, article_created_at``."""
    emb = read_table(spark, base, "embeddings", ["vec_id", "embedding"])
    art = articles(spark, base).select("article_uid", "created_at")
    return (art.join(emb, art.article_uid == emb.vec_id)
            .select("article_uid", "embedding", F.col("created_at").alias("article_created_at")))


def _entity_json(field: Column) -> Column:
    """Pack capitalised tokens of one field into the entity JSON document
    ``[{"entities": [{"name", "type", "salience"}, ...]}]``; a null type is
    omitted from the JSON, which exercises the no-type parse path."""
    toks = F.regexp_extract_all(field, F.lit(ENTITY_TOKEN_PATTERN), 0)
    types = F.array(*[F.lit(t).cast("string") for t in ENTITY_TYPES_BY_LENGTH_MOD_5])
    ents = F.transform(toks, lambda t, i: F.struct(
        t.alias("name"),
        F.element_at(types, (F.length(t) % 5 + 1).cast("int")).alias("type"),
        (F.lit(1.0) / (i + 1)).alias("salience")))
    return F.to_json(F.array(F.struct(ents.alias("entities"))))


def entities(spark: SparkSession, base: str) -> DataFrame:
    """Raw entity table: ``article_uid, created_at, text, seo_title, kicker_headline`` (JSON)."""
    art = articles(spark, base)
    return art.select("article_uid", "created_at",
                      _entity_json(F.col("text")).alias("text"),
                      _entity_json(F.col("seo_title")).alias("seo_title"),
                      _entity_json(F.col("headline")).alias("kicker_headline"))


def page_views(spark: SparkSession, base: str) -> DataFrame:
    """View counts per article: ``events`` of type view counted by ``user_id``."""
    ev = read_table(spark, base, "events", ["user_id", "event_type"])
    return (ev.filter(F.col("event_type") == "view")
            .groupBy(F.col("user_id").alias("article_uid"))
            .agg(F.count(F.lit(1)).alias("PageViews")))


def posts(spark: SparkSession, base: str) -> DataFrame:
    """Comments: ``ID_Article = user_id``; error → 'deleted', click → 'online'."""
    ev = read_table(spark, base, "events", ["user_id", "event_type"])
    return (ev.filter(F.col("event_type").isin("error", "click"))
            .select(F.col("user_id").alias("ID_Article"),
                    F.when(F.col("event_type") == "error", "deleted").otherwise("online").alias("Status")))


def pairs(spark: SparkSession, base: str) -> DataFrame:
    """(headline, second line of text) per article."""
    art = articles(spark, base)
    return art.select("article_uid", "headline", second_line(F.col("text")).alias("seo_title"))
