"""Near-duplicate documents by b-bit MinHash (operator 10).

1. One pass over the texts gives each document a hash of its shingle set, band keys
   (``bands`` x ``rows`` minima), and a packed b-bit signature: one-permutation minima in
   ``BINS`` bins, four low bits of each (0: empty bin), 512 bytes.
2. Documents with equal shingle sets collapse to the least id (a map-side-combined
   aggregate), so copies never meet in a bucket.
3. Candidates, without forming all pairs of a bucket: every member is first compared
   with its bucket's least member.  Confirmed links are merged by union-find; only
   buckets that still hold several components go on, and there only pairs from different
   components whose signatures estimate (collision-corrected bit counts) to
   ``similarity - slack`` or more, in blocks of ``block`` members so that a large bucket is
   spread over tasks.
4. Both kinds of candidates are confirmed on the full shingle sets.

Signatures and filters decide only what is compared: every reported link is exact.
A link is lost only if no band of the pair agrees (at the threshold 0.85 and 4 x 12: once in
7,000) or its estimate is off by more than ``slack`` (over four standard deviations).

Nulls and edge cases: a row without an id comes out kept, with null counts and component; null or
empty texts have no shingles and link with nothing; fewer words than ``words`` are one shingle; rows
that repeat an id get the same component (its least text stands for it when candidates are
confirmed); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import (binary_rows, bit_filter, by_batch, long_column, long_lists, materialise, passes,
                                prepare, release, table)
from tessera.llm.components import components

NAME = "op10_bbit_minhash"
ORACLE_SQL = None  # an exact all-pairs join in SQL is quadratic; tests hold it against brute force

BINS = 1024
_NIBBLE = np.uint64(0x1111111111111111)


def shingle_sets(buf, offs, width):
    """Distinct shingle hashes of each document: (document, hash) sorted, and offsets."""
    n = len(offs) - 1
    start, end, doc = B.words(buf, offs)
    h = B.span_hashes(buf, start, end)
    first = B.first_of_doc(doc, n)
    w, at = B.windows(h, doc, width)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # the whole sequence is the one shingle
        whole = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            v = np.full(1, count[d], np.uint64)
            for k in range(first[d], first[d + 1]):
                v = B.mix(v * np.uint64(0xD6E8FEB86659FD93) + h[k:k + 1])
            whole[i] = v[0]
        d, v = np.concatenate([doc[at], short]), np.concatenate([w, whole])
    else:
        d, v = doc[at], w
    d, v = B.distinct_per_doc(d, v)
    return d, v, B.first_of_doc(d, n)


def band_keys(v, first, bands, rows, seed):
    """(documents x bands) keys: each mixes ``rows`` independent minima."""
    g = np.random.default_rng(seed)
    low = (v >> np.uint64(16)).astype(np.uint32)
    keys = np.zeros((len(first) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first) - 1, b, np.uint64)
        for _ in range(rows):
            a, c = (np.uint32(x) for x in g.integers(1, 1 << 32, 2))
            h = low * (a | np.uint32(1)) + c
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            key = B.mix(key * np.uint64(0xD6E8FEB86659FD93) + B.reduce_docs(np.minimum, h, first, np.uint32(0)))
        keys[:, b] = key
    return keys


def packed_minima(d, v, n):
    """b-bit signature, b = 4: the least hash of each of BINS bins (the hash's top bits name
    the bin), reduced to 1..15; two bins to a byte, 0 for an empty bin.  d, v: sorted."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    cell = d.astype(np.int64) * BINS + (v >> shift).astype(np.int64)
    lead = np.empty(len(cell), bool)
    if len(cell):
        lead[0], lead[1:] = True, cell[1:] != cell[:-1]
    code = np.zeros(n * BINS, np.uint8)
    code[cell[lead]] = (B.mix(v[lead]) % np.uint64(15)).astype(np.uint8) + 1
    code = code.reshape(n, BINS)
    return code[:, 0::2] | (code[:, 1::2] << 4)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Resemblance of one signature (uint64 words) to many, corrected for the minima that
    agree by chance in 1 of 15 codes."""
    def used(x):
        x = x | (x >> np.uint64(2))
        return (x | (x >> np.uint64(1))) & _NIBBLE
    a, b = used(one), used(many)
    either = np.bitwise_count(a | b).sum(-1).astype(np.float64)
    both = np.bitwise_count(a & b).sum(-1).astype(np.float64)
    same = either - np.bitwise_count(used(one ^ many)).sum(-1)
    return (15 * same - both) / 14 / np.maximum(either, 1)


def signatures(docs: DataFrame, words: int = 3, bands: int = 12, rows: int = 4, seed: int = 7) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, keys, sig`` for every document with an id."""
    names = ["doc_id", "n_shingles", "s1", "s2", "keys", "sig"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = long_column(batch, "doc_id")
        buf, offs = B.text_buffer(batch.column("text"))
        parts = []
        for i, j in B.slices(offs):
            sub = offs[i:j + 1] - offs[i]
            d, v, first = shingle_sets(B.LOWER[buf[offs[i]:offs[j]]], sub, words)
            n = j - i
            keys = band_keys(v, first, bands, rows, seed)
            parts.append(pa.RecordBatch.from_arrays([
                pa.array(ids[i:j]), pa.array(np.diff(first).astype(np.int64)),
                pa.array(B.reduce_docs(np.add, v, first, np.uint64(0)).view(np.int64)),
                pa.array(B.reduce_docs(np.bitwise_xor, B.mix(v), first, np.uint64(0)).view(np.int64)),
                long_lists(keys.view(np.int64).ravel(), np.arange(n + 1) * bands),
                binary_rows(packed_minima(d, v, n))], names))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return (docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(by_batch(kernel), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, sig binary"))


def _confirm(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full sets."""
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sides = []
        for name in ("ta", "tb"):
            # a text that repeats within the batch is cut into shingles once
            col = batch.column(name).cast(pa.large_string()).dictionary_encode()
            buf, offs = B.text_buffer(col.dictionary)
            _, v, first = shingle_sets(B.LOWER[buf], offs, words)
            sides.append((col.indices.to_numpy(zero_copy_only=False), v, first))
        (ia, va, fa), (ib, vb, fb) = sides
        ok = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            x, y = va[fa[ia[k]]:fa[ia[k] + 1]], vb[fb[ib[k]]:fb[ib[k] + 1]]
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not len(x):
                continue
            both = np.sort(np.concatenate([x, y]))
            inter = int((both[1:] == both[:-1]).sum())
            ok[k] = 100 * inter >= percent * (len(both) - inter)
        keep = np.flatnonzero(ok)
        return pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])

    t = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    t = t.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return t.select("a", "b", "ta", "tb").mapInArrow(by_batch(kernel), "a long, b long")


def _cross_pairs(bands: int, least: float):
    """Group function over one block pair of one bucket: pairs of different components, both
    blocks' signatures alike enough, and no earlier band that agrees (each pair comes out once)."""
    def run(pdf):
        import pandas as pd

        ids, comp, blk = pdf["doc_id"].to_numpy(), pdf["comp"].to_numpy(), pdf["blk"].to_numpy()
        band = int(pdf["band"].iloc[0])
        keys = np.stack(pdf["keys"].to_numpy())
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint64).reshape(len(pdf), -1)
        size = pdf["n_shingles"].to_numpy()
        lo, hi = int(pdf["b1"].iloc[0]), int(pdf["b2"].iloc[0])
        values, counts = np.unique(comp, return_counts=True)
        main = values[np.argmax(counts)]
        out = [np.zeros((0, 2), np.int64)]
        # every cross-component pair has a member outside the largest component
        for i in np.flatnonzero(comp != main):
            other = (comp != comp[i]) & ((comp == main) | (ids > ids[i]))
            if lo != hi:
                other &= blk != blk[i]
            other &= np.minimum(size, size[i]) >= least * np.maximum(size, size[i])
            j = np.flatnonzero(other)
            if band and len(j):
                j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            if len(j):
                j = j[estimate(sig[i], sig[j]) >= least]
                out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, bands: int = 12, rows: int = 4,
                    slack: float = 0.05, block: int = 2048, filter_bits: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document of ``docs``."""
    sig = materialise(signatures(docs, words, bands, rows), "signatures")
    least = percent / 100 - slack
    real = sig.where("n_shingles > 0")
    klass = real.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    rep_of = materialise(real.select("doc_id", "n_shingles", "s1", "s2").join(klass, ["n_shingles", "s1", "s2"])
                         .select("doc_id", "rep").distinct(), "classes")
    reps = sig.where("n_shingles > 0").join(rep_of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    # buckets with at least two classes
    banded = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    members = materialise(banded.join(buckets, ["band", "key"]), "members")
    in_bucket = members.select("doc_id").distinct()
    wanted = bit_filter(in_bucket, "doc_id", filter_bits)
    likely = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    likely = likely.mapInArrow(by_batch(lambda b: b.filter(pa.array(passes(wanted, long_column(b, "doc_id"))))), "doc_id long, text string")
    texts = materialise(likely.join(in_bucket, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    # each member against its bucket's least member
    star = members.where("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialise(_confirm(texts, star, words, percent), "links")
    comp = components(links)
    # buckets that still hold several components
    tagged = (members.join(comp.select(F.col("v").alias("doc_id"), "root"), "doc_id", "left")
              .select("band", "key", "doc_id", "n", F.coalesce("root", "doc_id").alias("comp")))
    still = (tagged.groupBy("band", "key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2")
             .select("band", "key"))
    rest = tagged.join(still, ["band", "key"], "left_semi")
    n_blk = F.ceil(F.col("n") / block).cast("int")
    rest = rest.withColumns({"blk": F.pmod(F.xxhash64("doc_id"), n_blk).cast("int"), "n_blk": n_blk})
    # a bucket of m blocks becomes m (m + 1) / 2 block pairs
    other = F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("o")
    spread = (rest.select("*", other)
              .select("band", "key", "doc_id", "comp", "blk", F.least("blk", "o").alias("b1"), F.greatest("blk", "o").alias("b2"))
              .join(reps.select("doc_id", "n_shingles", "keys", "sig"), "doc_id"))
    cross = (spread.groupBy("band", "key", "b1", "b2")
             .applyInPandas(_cross_pairs(bands, least), "a long, b long").distinct())
    more = materialise(_confirm(texts, cross, words, percent), "links")
    final = components(links.unionByName(more))
    roots = (rep_of.join(final.select(F.col("v").alias("rep"), "root"), "rep", "left")
             .groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id")))
    out = sig.select("doc_id", "n_shingles").join(roots, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    release(members, texts)
    nameless = docs.where(F.col("doc_id").isNull()).select(*(F.lit(None).cast("long").alias(c) for c in out.columns))
    return out.unionByName(nameless).withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def query(spark, sf_dir):
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
