"""Benchmark decontamination by spaced-seed hashing (operator 8).

A spaced seed is a fixed mask over neighbouring tokens that hashes only the positions it cares
for, so a changed word inside a masked position does not hide a match.  Every mask position of
every document is hashed; positions whose hash a benchmark item has too are hits.  A hit fixes a
diagonal (document position - item position); along it the item is laid over the document and
verified: within the stretch where both exist, some run must hold at least ``min_match`` equal tokens
with at least ``share`` of its positions equal (substitutions only).  With the default rule every
such run, wherever its substitutions lie, holds a hit of one of the masks.  Items shorter than the
masks are looked for whole.

Work in Spark: benchmark seeds are joined by hash, not by pairs.  A Bloom filter of the seed
hashes (fixed size) lets tasks drop almost all positions of the corpus before anything is shuffled;
the exact join then runs on (document, position, hash) rows, hot passages being combined to one row
for each (document, item, diagonal).  Only documents with hits are verified: their texts meet the
benchmark items of their diagonals.

Tokens are lower-cased words without punctuation at their ends.  Nulls and edge cases: null or
empty texts have no hits; null ids and null items' texts are ignored by the join (a null id is
never contaminated); repeated document rows get the same verdict (the least text stands for an id
given to several texts); repeated items report the least id; an empty benchmark marks nothing; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import bit_filter, by_batch, long_column, materialise, passes, prepare, release, table

NAME = "op8_spaced_seeds"
ORACLE_SQL = None  # tests hold it against a brute-force search over all diagonals

#: Masks over token positions (1: hashed).  Every run of at least 10 equal tokens with a share of 0.75 is hit by one
#: of them (the tests go through all 931 runs that hold no shorter such run; a longer one than 25 has a part that is one).
MASKS = ("111111", "110101011", "1101100010011", "11100111", "11010010011", "1101100101", "111000101001")
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def tokens(buf: np.ndarray, offs: np.ndarray):
    """(hash, document) of the lower-cased words, ASCII punctuation at their ends stripped."""
    buf = B.LOWER[buf]
    s, e, doc = B.words(buf, offs)
    body = ~_PUNCTUATION[buf] & ~B.SEPARATOR[buf]
    at = np.flatnonzero(body)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lo = at[np.minimum(np.searchsorted(at, s), len(at) - 1)]
    hi = at[np.maximum(np.searchsorted(at, e) - 1, 0)] + 1
    keep = (lo >= s) & (lo < e) & (hi > lo)
    return B.span_hashes(buf, lo[keep], hi[keep]), doc[keep]


def seeds(h: np.ndarray, doc: np.ndarray, mask: str):
    """(hash, first position in ``h``) of one mask at every place that lies within one document."""
    care = [k for k, c in enumerate(mask) if c == "1"]
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, len(mask), np.uint64)
    for k in care:
        out = B.mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k:n + k])
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1:])
    return out[at], at


def item_seeds(h: np.ndarray):
    """(hash, position) rows of one benchmark item; a short item is one exact seed of its own length."""
    doc = np.zeros(len(h), np.int64)
    if 0 < len(h) < len(MASKS[0]):
        return seeds(h, doc, "1" * len(h))
    parts = [seeds(h, doc, m) for m in MASKS]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """``seed, item_id, item_pos, n`` for every seed of every item (n: the item's tokens)."""
    def kernel(batch):
        ids = long_column(batch, "item_id")
        buf, offs = B.text_buffer(batch.column("text"))
        h, doc = tokens(buf, offs)
        first = B.first_of_doc(doc, len(offs) - 1)
        rows = []
        for k in range(len(ids)):
            seed, at = item_seeds(h[first[k]:first[k + 1]])
            rows.append((seed.view(np.int64), np.full(len(seed), ids[k]), at, np.full(len(seed), first[k + 1] - first[k])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], ["seed", "item_id", "item_pos", "n"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInArrow(by_batch(kernel), "seed long, item_id long, item_pos long, n long")


def document_seeds(docs: DataFrame, likely: np.ndarray, short: list[int]) -> DataFrame:
    """``doc_id, seed, pos`` of the document seeds that the filter lets through.  ``short``: lengths
    of the items below the masks (at most five)."""
    masks = [*MASKS, *("1" * n for n in short)]

    def kernel(batch):
        ids = long_column(batch, "doc_id")
        buf, offs = B.text_buffer(batch.column("text"))
        out = [(np.zeros(0, np.int64),) * 3]
        for i, j in B.slices(offs):
            h, doc = tokens(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            first = B.first_of_doc(doc, j - i)
            for m in masks:
                seed, at = seeds(h, doc, m)
                seed = seed.view(np.int64)
                keep = np.flatnonzero(passes(likely, seed))
                d = doc[at[keep]]
                out.append((ids[i:j][d], seed[keep], at[keep] - first[d]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["doc_id", "seed", "pos"])

    return docs.mapInArrow(by_batch(kernel), "doc_id long, seed long, pos long")


def best_run(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(matches, first, last + 1) of the longest stretch of which at least ``share`` is equal, without
    mismatches at its ends.  If any stretch has m matches and the share, this one has m or more: it can
    only be as short as m / share, or as the whole of ``equal``."""
    total = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - share, -share))])
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -(total + 1e-9))  # the first place from which the sum to here is not negative
    size = np.arange(len(total)) - begin
    ends = np.flatnonzero(size == size.max())
    count = np.concatenate([[0], np.cumsum(equal)])
    end = int(ends[(count[ends] - count[begin[ends]]).argmax()])
    at = begin[end] + np.flatnonzero(equal[begin[end]:end])
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


def verify(hits: DataFrame, texts: DataFrame, benchmark: DataFrame, min_match: int, share: float) -> DataFrame:
    """``doc_id, item_id, matches, doc_start, doc_end`` of the diagonals that hold."""
    def kernel(batch):
        col = batch.column("text").cast(pa.large_string()).dictionary_encode()
        buf, offs = B.text_buffer(col.dictionary)
        h, doc = tokens(buf, offs)
        first = B.first_of_doc(doc, len(offs) - 1)
        which = col.indices.to_numpy(zero_copy_only=False)
        ibuf, ioffs = B.text_buffer(batch.column("item_text"))
        ih, idoc = tokens(ibuf, ioffs)
        ifirst = B.first_of_doc(idoc, len(ioffs) - 1)
        diagonal = batch.column("diagonal").to_numpy()
        keep, rows = [], []
        for k in range(batch.num_rows):
            item, text = ih[ifirst[k]:ifirst[k + 1]], h[first[which[k]]:first[which[k] + 1]]
            a, b = max(0, -int(diagonal[k])), min(len(item), len(text) - int(diagonal[k]))
            if b <= a:
                continue
            n, lo, hi = best_run(item[a:b] == text[a + diagonal[k]:b + diagonal[k]], share)
            if n >= min(min_match, len(item)):
                keep.append(k)
                rows.append((n, a + lo + int(diagonal[k]), a + hi + int(diagonal[k])))
        found = np.array(rows, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), batch.column("item_id").take(pa.array(keep, pa.int64())),
                                           *(pa.array(c) for c in found.T)], ["doc_id", "item_id", "matches", "doc_start", "doc_end"])

    items = benchmark.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("item_text"))
    t = hits.join(items, "item_id").join(texts, "doc_id")
    return t.select("doc_id", "item_id", "diagonal", "text", "item_text").mapInArrow(
        by_batch(kernel), "doc_id long, item_id long, matches long, doc_start long, doc_end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 10, share: float = 0.75,
                 filter_bits: int | None = None) -> DataFrame:
    """One row for each contaminated document and item with the best overlap (tokens from
    ``doc_start`` to ``doc_end``)."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bench = materialise(benchmark_seeds(benchmark), "seeds")
    short = sorted(r[0] for r in bench.where(F.col("n") < len(MASKS[0])).select("n").distinct().collect())
    found = document_seeds(docs, bit_filter(bench, "seed", filter_bits), short)
    hits = materialise(found.join(bench, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    hit_ids = hits.select("doc_id").distinct()
    wanted = bit_filter(hit_ids, "doc_id", filter_bits)
    likely = docs.mapInArrow(by_batch(lambda b: b.filter(pa.array(passes(wanted, long_column(b, "doc_id"))))), "doc_id long, text string")
    texts = likely.join(hit_ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = verify(hits, texts, benchmark, min_match, share)
    best = F.max(F.struct("matches", -F.col("doc_start"), -F.col("doc_end"))).alias("x")
    out = materialise(held.groupBy("doc_id", "item_id").agg(best)
                      .select("doc_id", "item_id", "x.matches", (-F.col("x.col2")).alias("doc_start"), (-F.col("x.col3")).alias("doc_end")), "contaminated")
    release(bench, hits)
    return out


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, contaminated, n_items, item_id, matches`` for every row of ``docs`` (item_id: the
    item with most matches, the least of several)."""
    found = contaminated(docs, benchmark, **options)
    one = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("matches", -F.col("item_id"))).alias("x"))
    one = one.select("doc_id", "n_items", (-F.col("x.col2")).alias("item_id"), F.col("x.matches").alias("matches"))
    return (docs.select(F.col("doc_id").cast("long")).join(one, "doc_id", "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                    "item_id", F.coalesce("matches", F.lit(0)).alias("matches")))


def query(spark, sf_dir):
    prepare(spark)
    return verdicts(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
