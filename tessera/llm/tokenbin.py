"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding (operator 6).

Ids are replaced by their corpus frequency rank (most frequent: 0) and written with one to four
data bytes each; two-bit lengths of four ids share one control byte, and control bytes are kept
apart from data bytes, so a reader finds every value with one table lookup for each control byte.

A token file is a Parquet file of blocks in ascending document order.  Block columns:
``shard, block`` (file and place in it), ``token_start`` (ids before it in its shard), ``n_docs``,
``n_tokens``, ``payload`` = doc ids (int64), token counts (int64), control bytes, data bytes, all
little-endian.  Beside the shards lies ``ranks``: id of each rank.  Everything is written through
Spark's committers, so any store works and a lost executor's blocks are written again.

Two passes over the texts' ids: the texts are tokenised once into a scratch table, whose counts
(one row for each vocabulary entry) give the ranks; then documents are range-partitioned by id
and encoded.  Nulls and edge cases: a null or empty text is its end id alone; null ids come first
(``-1`` inside the file would clash, so they are flagged by the smallest long); repeated rows are
written each, ordered by their ids; an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm import tokenids
from tessera.llm.common import by_batch, materialise, prepare, release, table
from tessera.session import checkpoint_dir

NAME = "op6_frequency_bytes"
ORACLE_SQL = None  # tests check the exact round trip

NULL_ID = -(1 << 63)
#: Data bytes of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
BLOCK_TOKENS = 1 << 18


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    two_bits = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    two_bits[:len(v)] = size - 1
    control = (two_bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = slice(None) if k == 0 else np.flatnonzero(size > k)
        data[at[has] + k] = (v[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control, data


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_table(docs: DataFrame, encoder_args: tuple, end_id: int = 1) -> DataFrame:
    """``doc_id, ids`` (little-endian; 2 bytes each where the vocabulary allows, else 4)."""
    def kernel(batch):
        out = []
        encode = tokenids.encoder(*encoder_args)
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for _, ids, offs in encode.encode(batch.column("text")):
            ids = ids.astype(kind)
            n = np.diff(offs) + 1
            whole = np.insert(ids, offs[1:], end_id).tobytes()
            at = np.concatenate([[0], np.cumsum(n)]) * int(kind[-1])
            out += [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(out, pa.binary()),
                                           pa.array([int(kind[-1])] * len(out), pa.int32())], ["doc_id", "ids", "width"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(by_batch(kernel), "doc_id long, ids binary, width int"))


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a token table batch."""
    raw, offs = B.text_buffer(batch.column("ids"))
    width = batch.column("width")[0].as_py()
    return np.frombuffer(raw.tobytes(), f"<u{width}"), offs // width


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by falling corpus frequency, then id; as many as the vocabulary has in use."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = np.bincount(_ids(batch)[0], minlength=len(total))
                n[:len(total)] += total
                total = n
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write_token_files(docs: DataFrame, path: str, encoder_args: tuple, end_id: int = 1) -> None:
    """Write ``path``/shards and ``path``/ranks."""
    spark = docs.sparkSession
    tokens = materialise(token_table(docs, encoder_args, end_id), "tokens")
    by_rank = frequency_ranks(tokens)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches):
        shard, block, done = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offs = _ids(batch)
            doc = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for i, j in B.slices(offs, BLOCK_TOKENS):
                control, data = encode_values(rank[ids[offs[i]:offs[j]]])
                n = np.diff(offs[i:j + 1])
                payload = b"".join(x.tobytes() for x in (doc[i:j].astype("<i8"), n.astype("<i8"), control, data))
                yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "token_start": done, "n_docs": j - i,
                                                   "n_tokens": int(n.sum()), "payload": payload}], schema)
                block += 1
                done += int(n.sum())

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("token_start", pa.int64()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64()), ("payload", pa.binary())])
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    (ordered.mapInArrow(blocks, "shard int, block int, token_start long, n_docs long, n_tokens long, payload binary")
     .write.option("compression", "zstd").parquet(f"{path}/shards"))
    release(tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    shards = spark.read.parquet(f"{path}/shards")
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    totals = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n_docs, n_tokens = batch.column("n_docs")[k].as_py(), batch.column("n_tokens")[k].as_py()
                raw = np.frombuffer(batch.column("payload")[k].as_buffer(), np.uint8)
                doc, n = raw[:16 * n_docs].view("<i8").reshape(2, n_docs)
                n_control = -(-n_tokens // 4)
                body = raw[16 * n_docs:]
                out = ids[decode_values(body[:n_control], body[n_control:], n_tokens)].astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(out[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, mask=doc == NULL_ID), pa.array(at[:-1] + batch.column("start")[k].as_py()),
                    pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    at = shards.join(F.broadcast(first), "shard").select((F.col("token_start") + F.col("shard_start")).alias("start"), "n_docs", "n_tokens", "payload")
    return at.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    prepare(spark)
    path = f"{checkpoint_dir(spark)}/tessera-llm/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenids.word_bpe())
    return read_token_files(spark, path)
