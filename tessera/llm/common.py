"""Session, scratch tables and small shared steps of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bytescan import mix
from tessera.session import checkpoint_dir, ensure_conf

#: Rows of one Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    ensure_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, base: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*cols) if cols else df


def id_remainder(doc_id: str | Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; -1 for a null id (never a fold of its own)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % m, F.lit(-1))


def materialise(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back:
    lineage is cut, every executor sees the files, and a lost executor rereads them.
    ``batch_rows``: rows of one Arrow batch while it runs (more where no row holds a text)."""
    path = f"{checkpoint_dir(df.sparkSession)}/tessera-llm/{name}-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    if batch_rows != BATCH_ROWS:
        conf.set(key, str(batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def by_batch(kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """``mapInArrow`` function that runs ``kernel`` on every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = kernel(batch)
                if out is not None and out.num_rows:
                    yield out
    return run


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a uint8 matrix."""
    n, width = matrix.shape
    offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix))])


def long_lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """list<long> rows from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)))


#: Least and most bits (as powers of two) of a ``bit_filter``: 128 KB to 16 MB.
FILTER_BITS = (20, 27)


def _slots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each id among 2**bits."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    low = np.uint64((1 << bits) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def bit_filter(ids: DataFrame, col: str, bits: int | None = None) -> np.ndarray | None:
    """A two-hash Bloom filter of a long column: 16 bits a row (one id in 60 is let through by
    chance), at least 2**20 and at most 2**27 bits (16 MB, up to 8 million rows).  For more rows than
    such a filter can tell apart (it would be 98 % full) there is none, and everything goes on to the
    exact join that must follow anyway.  It never loses an id."""
    ids = ids.where(F.col(col).isNotNull()).select(F.col(col).cast("long").alias("id"))
    if bits is None:
        n = ids.count()
        if n > 2 << FILTER_BITS[1]:
            return None
        bits = min(max(FILTER_BITS[0], (16 * n).bit_length()), FILTER_BITS[1])

    def run(batches):
        for batch in batches:
            slot = np.concatenate(_slots(batch.column(0).to_numpy(), bits))
            word, where = np.unique(slot >> 5, return_inverse=True)
            out = np.zeros(len(word), np.int64)
            np.bitwise_or.at(out, where, 1 << (slot & 31))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(out)], ["w", "b"])

    rows = ids.mapInArrow(run, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def passes(filter_words: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    """Mask of the ids that ``bit_filter`` may hold."""
    if filter_words is None:
        return np.ones(len(ids), bool)
    one, two = _slots(ids, int(len(filter_words)).bit_length() - 1 + 5)
    return ((filter_words[one >> 5] >> (one & 31).astype(np.uint32)) & (filter_words[two >> 5] >> (two & 31).astype(np.uint32)) & 1) == 1


def fitting_labels(labels: DataFrame, flag: str, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted doc ids, labels) of the rows to learn from: all labelled documents, or a hash
    sample of about ``max_labelled`` of them when there are more.  Repeated labels of one
    document give their maximum; null ids and labels are ignored."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(flag).isNotNull())
           .groupBy("doc_id").agg(F.max(flag).alias("y")))
    n = one.count()
    if n > max_labelled:
        share = int((1 << 30) * (max_labelled / n) * 0.98)
        one = one.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 30}L) < {share}L"))
    rows = one.select("doc_id", F.col("y").cast("int").alias("y")).toArrow()
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy()
    order = np.argsort(ids)[:max_labelled]
    return ids[order].astype(np.int64), y[order].astype(np.int8)


def label_of(ids: np.ndarray, fit_ids: np.ndarray, fit_y: np.ndarray) -> np.ndarray:
    """Label of each id, -1 where it has none."""
    out = np.full(len(ids), -1, np.int8)
    if len(fit_ids):
        at = np.minimum(np.searchsorted(fit_ids, ids), len(fit_ids) - 1)
        hit = fit_ids[at] == ids
        out[hit] = fit_y[at[hit]]
    return out


def long_column(batch: pa.RecordBatch, name: str, null: int = -1) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def split_by(docs: DataFrame, ids: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id a ``bit_filter`` may hold, the other rows); rows without an id are others."""
    def pick(inside: bool):
        def kernel(batch):
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            return batch.filter(pa.array((passes(ids, long_column(batch, "doc_id")) & named) == inside))
        return docs.mapInArrow(by_batch(kernel), docs.schema)

    return pick(True), pick(False)


def without(docs: DataFrame, ids: DataFrame, bits: int | None = None) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``ids`` (a bit filter lets most texts pass without a
    shuffle; only rows it may hold meet the exact anti-join).  Rows without an id stay."""
    ids = ids.select(F.col("doc_id").cast("long").alias("_id")).where(F.col("_id").isNotNull()).distinct()
    ids = materialise(ids, "ids")
    maybe, others = split_by(docs, bit_filter(ids, "_id", bits))
    kept = maybe.join(ids, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    return others.unionByName(kept)


def one_row_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: of several the least by all columns, in order of the columns.  Only rows
    of repeated ids are shuffled.  Rows without an id stay."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    ids = materialise(ids.where("n > 1").select("_id"), "ids")
    maybe, others = split_by(docs, bit_filter(ids, "_id"))
    same = F.col("doc_id").cast("long") == F.col("_id")
    least = (maybe.join(ids, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row"))
             .select(*(F.col("_row")[c].alias(c) for c in docs.columns)))
    return others.unionByName(maybe.join(ids, same, "left_anti")).unionByName(least)
