"""Structured Streaming jobs.

The reference polls a table every minute and processes new rows in batch.
Here the same work is a file stream run with ``Trigger.AvailableNow`` (or any
trigger the caller picks): progress lives in the checkpoint folder, so a
restarted or re-run job resumes where it stopped, and every sink write is
keyed so that replaying a micro-batch adds nothing.

* W1 ``ingest_new``: new articles -> anti join with the stored keys (also
  catches keys older than the watermark) -> compose + clean text -> embed ->
  normalise -> keyed append.
* W2 ``label_stream``: new vectors -> incremental topic labels (C7) against
  the stored labels -> keyed append.
* W3 ``daily_volume_stream``: event counts per day with a watermark; update
  mode, so state for days older than the watermark is dropped, and each
  micro-batch upserts its changed days (last write per day wins).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir, drop
from tessera.sources.tables import has_data, is_file

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint folder."""
    root = checkpoint_dir(spark)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _file_stream(spark: SparkSession, source: str, schema: T.StructType, max_files: int | None) -> DataFrame:
    """File stream over a folder, or over one file (its folder filtered to
    that file name): the file source watches folders."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_file(spark, source):
        folder, _, name = source.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(source)


def _stored_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if has_data(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)  # nothing written yet; a failing read raises


def daily_volume_stream(spark: SparkSession, source: str, out: str | None = None, ts: str = "ts",
                        delay: str = "1 day", schema: T.StructType = EVENTS_SCHEMA,
                        max_files_per_trigger: int | None = None, trigger_once: bool = True) -> DataFrame:
    """Run the stream to completion and return ``(date, n)``.

    Each micro-batch appends ``(date, n, batch_id)`` for the days it changed;
    the result keeps the last batch's value per day (``max_by``)."""
    out = out or scratch(spark, "daily-volume")
    ev = _file_stream(spark, source, schema, max_files_per_trigger)
    # watermarks need TIMESTAMP; zone-less values are read as UTC wall clock
    ev = ev.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = (ev.withWatermark(ts, delay)
              .groupBy(F.window(F.col(ts), "1 day").alias("w"))
              .agg(F.count(F.lit(1)).alias("n")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.to_date(F.col("w.start")).alias("date"), F.col("n").cast("bigint").alias("n"),
                      F.lit(batch_id).cast("bigint").alias("batch_id"))
         .write.mode("append").parquet(f"{out}/data"))

    q = (counts.writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", f"{out}/_checkpoint"))
    q = q.trigger(availableNow=True) if trigger_once else q
    q.start().awaitTermination()
    rows = _stored_or_empty(spark, f"{out}/data",
                            T.StructType([T.StructField("date", T.DateType()), T.StructField("n", T.LongType()),
                                          T.StructField("batch_id", T.LongType())]))
    return rows.groupBy("date").agg(F.max_by("n", "batch_id").alias("n"))


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, store: str,
               transform, key: str = "article_uid", ts: str = "created_at", delay: str = "1 day",
               max_files_per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """Exactly-once ingestion of new rows.

    ``transform(batch_df) -> DataFrame`` is the per-batch work (clean, embed,
    normalise ...).  Keys are de-duplicated within the watermark by the
    stream, and against everything already stored by an anti join, so a key
    whose first row the stream has forgotten is still caught.  The state holds the keys of the
    last ``delay`` only; a row older than the watermark is late and ignored.  Returns the stored table."""
    from tessera.sources.tables import append

    checkpoint = checkpoint or f"{store}_checkpoint"
    src = _file_stream(spark, source, schema, max_files_per_trigger)
    if ts is not None:
        src = src.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch)
        append(out, store, key)  # (reads it once, for its keys and its rows alike)
        drop(out)  # (what the transform has held for it)

    (src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(store)


def label_stream(spark: SparkSession, source: str, schema: T.StructType, labels_store: str,
                 vectors_store: str, eps: float, min_samples: int, min_cluster_size: int,
                 key: str = "id", vec: str = "vec", checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Incremental topic labels (C7) for each micro-batch of new vectors,
    against the labels and vectors stored so far; both stores are appended
    keyed, so labels of earlier rows never move."""
    from tessera.operators.cluster import assign_topics
    from tessera.sources.tables import append

    checkpoint = checkpoint or labels_store + "_checkpoint"
    src = _file_stream(spark, source, schema, max_files_per_trigger)
    lab_schema = T.StructType([T.StructField(key, schema[key].dataType), T.StructField("cluster", T.IntegerType())])

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = batch.select(key, vec).dropDuplicates([key])
        stored_vecs = _stored_or_empty(spark, vectors_store, new.schema)
        new = new.join(stored_vecs.select(key), key, "left_anti")
        stored_labels = _stored_or_empty(spark, labels_store, lab_schema)
        labelled = stored_vecs.join(stored_labels, key)
        if labelled.isEmpty():
            from tessera.operators.cluster import density_cluster

            lab = density_cluster(new, eps, min_samples, min_cluster_size, key, vec)
        else:
            lab = assign_topics(new, labelled, eps, min_samples, min_cluster_size, key, vec)
        lab = lab.persist()
        append(lab, labels_store, key)
        append(new, vectors_store, key)
        lab.unpersist()

    (src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(labels_store)


def embedding_flow(spark: SparkSession, docs: DataFrame, encoder: DataFrame, reducer_path: str, vectors_store: str,
                   reduced_store: str, key: str = "doc_id", text: str = "text", one_each: bool = False) -> DataFrame:
    """One batch of the embedding flow: documents not stored yet are encoded and appended keyed,
    then reduced with the saved reducer and appended keyed to the second table.  Both writes skip
    stored keys, so a batch that failed between them is completed by running it again.  Rows that repeat a
    key are one document, or, with ``one_each``, one of them is.  Returns ``(key, dim, reduced)`` of
    everything stored."""
    from pyspark.ml.feature import PCAModel

    from tessera.operators import embed as EM
    from tessera.sources.tables import append

    new = docs
    if has_data(spark, vectors_store):
        new = docs.join(spark.read.parquet(vectors_store).select(key), key, "left_anti")
    append(EM.apply_encoder(new, encoder, key, text, one_each=one_each, one_row=True), vectors_store, key)
    vectors = spark.read.parquet(vectors_store)
    todo = vectors
    if has_data(spark, reduced_store):
        todo = vectors.join(spark.read.parquet(reduced_store).select(key), key, "left_anti")
    append(EM.reduce(todo, PCAModel.load(reducer_path), "vec", "reduced").select(key, "reduced"), reduced_store, key)
    reduced = spark.read.parquet(reduced_store)
    return vectors.join(reduced, key, "left").select(key, F.size("vec").alias("dim"), "reduced")


def embed_stream(spark: SparkSession, source: str, schema: T.StructType, encoder: DataFrame, reducer_path: str,
                 vectors_store: str, reduced_store: str, key: str = "doc_id", text: str = "text",
                 max_files_per_trigger: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """W1 with V7: ``embedding_flow`` for each micro-batch of new documents, so that every article has
    its vector in one table and its reduced vector, under the same key, in the other."""
    checkpoint = checkpoint or f"{vectors_store}_checkpoint"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the texts are read once and where they are: of rows that repeat a key one vector is kept
        embedding_flow(spark, batch.select(key, text), encoder, reducer_path, vectors_store, reduced_store, key, text, one_each=True)

    (_file_stream(spark, source, schema, max_files_per_trigger).writeStream.foreachBatch(handle)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(vectors_store).join(spark.read.parquet(reduced_store), key, "left")
