"""Scans, lookups and sinks.

All readers return lazy DataFrames so that Catalyst can push filters and column
pruning into the parquet / CSV scan.  Writers are keyed and idempotent where the
reference relied on a database UNIQUE key.
"""

from __future__ import annotations

import os
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day-first formats tried in order for article timestamps.
DAY_FIRST_FORMATS = (
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "dd/MM/yyyy",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
)

ARTICLE_CSV_SCHEMA = T.StructType([
    T.StructField("article_uid", T.StringType()),
    T.StructField("cms_id", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("seo_title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("is_premium", T.BooleanType()),
])

ENTITY_CSV_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("kicker_headline", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("seo_title", T.StringType()),
    T.StructField("created_at_ne", T.StringType()),
    T.StructField("updated_at", T.StringType()),
    T.StructField("parset", T.StringType()),
])


def read_table(spark: SparkSession, base: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Whole-table scan of ``{base}/{name}.parquet`` (or a catalog table)."""
    path = os.path.join(base, f"{name}.parquet")
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def deal(df: DataFrame, key: str) -> DataFrame:
    """Re-deal a scan over ``spark.tessera.scanTasks`` tasks if the session sets that key.

    Unset (the default, and the right choice on a cluster) it is the scan itself, split by
    ``spark.sql.files.maxPartitionBytes``.  The bench sets it because each of its input files is
    one row group, which no reader can split."""
    tasks = df.sparkSession.conf.get("spark.tessera.scanTasks", None)
    return df.repartition(int(tasks), key) if tasks else df


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, in whatever store its scheme names."""
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p))


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder holds any data file yet (files of a running or failed write begin
    with ``_`` or ``.`` and do not count)."""
    p, fs = _hadoop_path(spark, path)
    if not fs.exists(p):
        return False
    return any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


def parse_day_first(c: Column | str, formats: Iterable[str] = DAY_FIRST_FORMATS) -> Column:
    """Day-first timestamp parsing: first format that parses wins, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def read_articles(spark: SparkSession, path: str, sep: str = ",",
                  schema: T.StructType = ARTICLE_CSV_SCHEMA,
                  drop_malformed: bool = False) -> DataFrame:
    """Header CSV of articles, day-first ``created_at``.

    ``drop_malformed`` is the ``error_bad_lines=False`` variant (S2).  A missing
    path yields ``None`` as in the reference loader.
    """
    reader = (spark.read.schema(schema).option("header", True)
              .option("multiLine", True).option("escape", '"').option("sep", sep))
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED")
    if not path_exists(spark, path):
        return None
    return reader.csv(path).withColumn("created_at", parse_day_first("created_at"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """S3: header-less entity CSV with given names; keyed on ``article_id``."""
    df = (spark.read.schema(ENTITY_CSV_SCHEMA).option("header", False)
          .option("multiLine", True).option("escape", '"').csv(path))
    return (df.drop("_id", "updated_at", "parset")
              .withColumnRenamed("article_id", "article_uid"))


def latest(df: DataFrame, n: int | None, ts: str = "created_at",
           key: str = "article_uid") -> DataFrame:
    """``ORDER BY ts DESC LIMIT n`` (n=None: all rows).

    The key breaks ties so the limit is deterministic; Spark plans it as a
    ``TakeOrderedAndProject`` (per-partition top-n, then a merge of n·partitions
    rows), never a full sort.
    """
    ordered = df.orderBy(F.col(ts).desc_nulls_last(), F.col(key).asc())
    return ordered if n is None else ordered.limit(int(n))


def by_ids(df: DataFrame, ids, key: str = "article_uid") -> DataFrame:
    """Rows whose key is in ``ids`` (scalar, list or a DataFrame of keys).

    Small literal lists become an ``IN`` predicate pushed into the scan; a
    DataFrame of keys becomes a left-semi join (AQE broadcasts it when its
    runtime size is below the broadcast threshold, else sort-merge).
    Duplicate keys in ``df`` are all returned, as in the reference.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    if not isinstance(ids, (list, tuple, set)):
        ids = [ids]
    return df.filter(F.col(key).isin(list(ids)))


def has_rows(df: DataFrame) -> bool:
    """Non-empty test; reads at most one row."""
    return not df.isEmpty()


def ensure_table(spark: SparkSession, name: str, schema: T.StructType,
                 path: str | None = None) -> bool:
    """``CREATE TABLE IF NOT EXISTS``; returns whether it existed before."""
    existed = spark.catalog.tableExists(name)
    if not existed:
        spark.catalog.createTable(name, path=path, schema=schema, source="parquet")
    return existed


def append(df: DataFrame, path: str, key: str = "article_uid") -> None:
    """Keyed append.  Rows whose key is already stored are skipped and keys
    are de-duplicated inside the batch, so re-running a batch adds nothing
    (the UNIQUE key of the reference's DDL).  Any failure to read the stored
    keys raises: nothing is appended unchecked."""
    spark = df.sparkSession
    batch = df.dropDuplicates([key])
    if has_data(spark, path):
        batch = batch.join(spark.read.parquet(path).select(key), key, "left_anti")
    batch.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Replace a table's contents in one overwrite."""
    df.write.mode("overwrite").parquet(path)
