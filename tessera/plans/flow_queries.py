"""Flow queries: embedding, reduction, streams, splits.

Vectors from the default encoder and PCA coordinates have no SQL twin; they
are checked by row counts here and by property tests under ``tests/``.  The
streams run to completion (``availableNow``) into a fresh folder under the
session's checkpoint folder and return what they stored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import embed as EM
from tessera.operators import relational as R
from tessera.plans import sqltext as SQ
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.session import drop, hold
from tessera.sources import fixtures as FX
from tessera.sources.tables import deal, read_table
from tessera.streaming import ingest as ST

REDUCED_DIM = 32
SPLIT_SEED = 1
TEST_PERCENT = 20


@register("embed")
def q_embed(spark, base):
    """V1: default encoder over the composed, cleaned article text (unit vectors)."""
    art = FX.articles(spark, base).select("article_uid", TX.compose_text("seo_title", "text").alias("text"))
    v = EM.embed(art, key="article_uid")
    return v.select("article_uid", "vec", F.size("vec").alias("dim"),
                    F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


def _vectors(spark, base):
    e = read_table(spark, base, "embeddings", ["vec_id", "embedding"])
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@register("reduce")
def q_reduce(spark, base):
    """V6 + V7: PCA to 32 components fitted on all vectors (a distributed Gram sum), applied to all."""
    av = FX.article_vectors(spark, base).select(F.col("article_uid").alias("id"),
                                               F.col("embedding").cast("array<double>").alias("vec"),
                                               "article_created_at")
    model = EM.fit_reducer(av, REDUCED_DIM)
    r = EM.reduce(av, model, out="r")
    return r.select("id", F.col("r").alias("reduced"), F.size("r").alias("dim"))


@register("layout")
def q_layout(spark, base):
    """V8: 2-D coordinates for display."""
    return EM.layout(_vectors(spark, base), 2)


@register("reduce_and_cluster")
def q_reduce_and_cluster(spark, base):
    """PCA to 32 components, then density clustering."""
    return EM.reduce_and_cluster(_vectors(spark, base), REDUCED_DIM, 0.9, 1, 3)


@register("reduce_cluster_report")
def q_reduce_cluster_report(spark, base):
    """C3 with display coordinates and the silhouette of its clusters."""
    return EM.reduce_cluster_report(_vectors(spark, base), REDUCED_DIM, 0.9, 1, 3)


@register("split_pairs", with_views(["pairs"], select=f"""
    SELECT article_uid, a AS headline, b AS title,
           CASE WHEN CAST('0x' || substr(md5('{SPLIT_SEED}:' || article_uid), 1, 8) AS BIGINT) % 100 < {TEST_PERCENT}
                THEN 'test' ELSE 'train' END AS split
    FROM (SELECT article_uid, {SQ.clean_hard('headline')} AS a, {SQ.clean_hard('seo_title')} AS b FROM pairs)
    WHERE length(a) > 3 AND length(b) > 3"""))
def q_split_pairs(spark, base):
    """Reproducible 80/20 split of the headline pairs by a seeded key hash."""
    from tessera.plans.text_queries import q_build_pairs

    return R.split_rows(q_build_pairs(spark, base), "article_uid", TEST_PERCENT, SPLIT_SEED)


@register("daily_volume_stream", """
    SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1""")
def q_daily_volume_stream(spark, base):
    """Daily event counts from a watermarked stream (stream = batch)."""
    return ST.daily_volume_stream(spark, f"{base}/events.parquet")


_DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@register("ingest_new", with_views(["articles"], select=f"""
    SELECT article_uid, {SQ.clean_article(SQ.strip_title('seo_title', True) + " || '. ' || text")} AS composed
    FROM articles"""))
def q_ingest_new(spark, base):
    """Stream documents in, build articles, clean, embed and store keyed;
    returns the stored keys and texts (the vectors are stored alongside)."""
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(_DOC_SCHEMA)
    def compose(batch):
        art = deal(batch.select(F.col("doc_id").alias("article_uid"), "text", "source"), "article_uid")
        seo = F.concat(FX.first_line(F.col("text")), F.lit(" - "), F.col("source"), F.lit(FX.SEO_SUFFIX))
        return art.select("article_uid", TX.compose_text(seo, F.col("text")).alias("composed"))

    # the encoder is fitted once and stored: a vector never depends on the batch it came in
    composed = hold(compose(read_table(spark, base, "documents")), "composed")
    encoder = hold(EM.fit_encoder(composed, "composed"), "encoder")
    drop(composed)

    def transform(batch):  # composed once, read for the terms and for the rows
        comp = hold(compose(batch), "composed")
        out = comp.join(EM.apply_encoder(comp, encoder, "article_uid", "composed", one_row=True), "article_uid", "left")
        out._held_path = comp._held_path  # (dropped when the batch is stored)
        return out

    store = ST.scratch(spark, "ingest")
    out = ST.ingest_new(spark, f"{base}/documents.parquet", schema, store, transform, key="article_uid", ts=None)
    return out.select("article_uid", "composed")


@register("ingest_dedup", """
    SELECT event_id, event_type FROM events""")
def q_ingest_dedup(spark, base):
    """Events of two deliveries stored once each.  The first delivery repeats a third of its keys an
    hour later (dropped within the watermark); the second sends them again 20 days later, when the
    stream has forgotten them (caught by the stored keys)."""
    ev = read_table(spark, base, "events", ["event_id", "ts", "event_type"])
    early = ev.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    third = early.filter(F.col("event_id") % 3 == 0)
    again = lambda after: third.withColumn("ts", F.col("ts") + F.expr(f"interval {after}"))
    root = ST.scratch(spark, "deliveries")
    for part in (early.unionByName(again("1 hour")), ev.join(early.select("event_id"), "event_id", "left_anti").unionByName(again("20 days"))):
        part.write.mode("append").parquet(f"{root}/in")
        out = ST.ingest_new(spark, f"{root}/in", ev.schema, f"{root}/store", lambda b: b, key="event_id", ts="ts", delay="1 day",
                            checkpoint=f"{root}/progress")
    return out.select("event_id", "event_type")


@register("embed_stream", """
    SELECT doc_id, true AS same FROM documents""")
def q_embed_stream(spark, base):
    """W1 with V7: every document's reduced vector, stored by the stream, equals the batch's."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    encoder = hold(EM.fit_encoder(docs), "encoder")
    root = ST.scratch(spark, "embed-stream")
    batch = hold(EM.apply_encoder(docs, encoder), "vectors")
    model = EM.fit_reducer(batch, REDUCED_DIM)
    model.write().overwrite().save(f"{root}/reducer")
    got = ST.embed_stream(spark, f"{base}/documents.parquet", docs.schema, encoder, f"{root}/reducer", f"{root}/vectors", f"{root}/reduced")
    want = EM.reduce(batch, model, "vec", "want").select("doc_id", "want")
    near = F.forall(F.zip_with("reduced", "want", lambda a, b: F.abs(a - b) < 1e-9), lambda x: x)
    return want.join(got.select("doc_id", "reduced"), "doc_id", "left").select(
        "doc_id", F.coalesce(near, F.col("reduced").isNull() & F.col("want").isNull()).alias("same"))


@register("encoder_weights", f"""
    WITH d AS (SELECT count(*) AS n FROM documents),
         t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{TX.WORD}{{2,}}'))) AS term FROM documents)
    SELECT term, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM t, d GROUP BY term
    UNION ALL SELECT NULL, round(ln(n + 1) + 1, 6) FROM d""")
def q_encoder_weights(spark, base):
    """V1: the fitted encoder table over all documents."""
    return EM.fit_encoder(read_table(spark, base, "documents", ["text"])).select("term", F.round("idf", 6).alias("idf"))


@register("embedding_flow")
def q_embedding_flow(spark, base):
    """The whole embedding flow: encode with the fitted encoder, store, reduce with the saved
    reducer, store the reduced vectors under the same keys."""
    docs = read_table(spark, base, "documents", ["doc_id", "text"])
    encoder = hold(EM.fit_encoder(docs), "encoder")
    root = ST.scratch(spark, "embedding-flow")
    batch = hold(EM.apply_encoder(docs, encoder), "vectors")  # (the fit reads it several times)
    model = EM.fit_reducer(batch, REDUCED_DIM)
    drop(batch)
    model.write().overwrite().save(f"{root}/reducer")
    return ST.embedding_flow(spark, docs, encoder, f"{root}/reducer", f"{root}/vectors", f"{root}/reduced")


@register("apply_and_cluster")
def q_apply_and_cluster(spark, base):
    """C4 (with V6 persistence): a reducer fitted on all vectors is
    saved with the ML writer under the shared checkpoint folder, loaded back,
    applied to all vectors, and the reduced vectors are density-clustered."""
    av = FX.article_vectors(spark, base).select(F.col("article_uid").alias("id"),
                                               F.col("embedding").cast("array<double>").alias("vec"),
                                               "article_created_at")
    model = EM.fit_reducer(av, REDUCED_DIM)
    path = ST.scratch(spark, "reducer")
    model.write().overwrite().save(path)
    return EM.apply_and_cluster(av.select("id", "vec"), path, 0.9, 1, 3).withColumnRenamed("id", "article_uid")
