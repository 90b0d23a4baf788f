"""Stream = batch, and re-running ingestion adds nothing."""

import os
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.streaming import ingest as ST


def test_daily_volume_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="tessera-stream-src-")
    t = pq.read_table(os.path.join(SF_SMALL, "events.parquet"))
    half = t.num_rows // 2
    pq.write_table(t.slice(0, half), os.path.join(src, "part-0.parquet"))
    pq.write_table(t.slice(half), os.path.join(src, "part-1.parquet"))
    got = {r.date: r.n for r in ST.daily_volume_stream(spark, src, max_files_per_trigger=1).collect()}
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    want = {r.date: r.n for r in ev.groupBy(F.to_date("ts").alias("date")).count().withColumnRenamed("count", "n").collect()}
    assert got == want


def test_ingest_twice_adds_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    from pyspark.sql import types as T

    store = tempfile.mkdtemp(prefix="tessera-store-") + "/t"

    def transform(b):
        return b.select(F.col("doc_id").alias("article_uid"), F.length("text").alias("n"))

    src = os.path.join(SF_SMALL, "documents.parquet")
    first = ST.ingest_new(spark, src, T._parse_datatype_string(schema), store, transform, ts=None,
                          checkpoint=tempfile.mkdtemp(prefix="tessera-ck-"))
    n1 = first.count()
    again = ST.ingest_new(spark, src, T._parse_datatype_string(schema), store, transform, ts=None,
                          checkpoint=tempfile.mkdtemp(prefix="tessera-ck-"))
    assert n1 == 200 and again.count() == n1


def test_repeated_and_late_keys_within_and_beyond_the_watermark(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import types as T

    schema = T._parse_datatype_string("id long, ts timestamp_ntz, what string")
    root = tempfile.mkdtemp(prefix="tessera-watermark-")
    day = datetime(2024, 5, 1)
    deliveries = [
        [(1, day, "first"), (1, day + timedelta(hours=2), "again"), (2, day + timedelta(days=4), "first")],
        [(1, day + timedelta(days=9), "forgotten"), (3, day, "too late"), (4, day + timedelta(days=8), "first"), (2, day + timedelta(days=4), "again")],
        [(5, day + timedelta(days=30), "first"), (4, day + timedelta(days=29), "forgotten")],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        out = ST.ingest_new(spark, f"{root}/in", schema, f"{root}/store", lambda b: b, key="id", ts="ts", delay="1 day", checkpoint=f"{root}/progress")
    assert sorted((r.id, r.what) for r in out.collect() if r.id != 1) == [(2, "first"), (4, "first"), (5, "first")]
    assert [r.what for r in out.collect() if r.id == 1] in (["first"], ["again"])  # either row of one batch may stay
    # the state holds no more keys than the last day brought
    state = spark.read.format("statestore").load(f"{root}/progress")
    assert state.count() <= 2
