"""Packing documents into fixed windows by cutting-stock column generation (operator 9).

A document's tokens are cut into full windows and one remainder; a remainder longer than half a
window is cut at the half, so that no piece is too large to share a window.  The pieces below a
full window form a cutting-stock problem over the histogram of their lengths, which has at most
window / 2 rows whatever the corpus.  Its linear program, over patterns (multisets of length
classes that fit a window), is solved by revised simplex; a knapsack dynamic program prices new
patterns from the duals until none improves or the gap to the material bound is below ``gap``.
Pattern counts are rounded down to whole uses with exact lengths, and what is left is packed
best-fit decreasing.

Pieces of one length are interchangeable, so they only need ranks: pieces are dealt into hash
buckets of bounded size, ranked by document there, and the buckets' histograms give the offsets.
The (length, rank) -> (sequence, offset) table has a few thousand rows at any scale.

Nulls and edge cases: a null or empty text is its end id alone; a null id is packed like any
other; repeated rows are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokenids
from tessera.llm.common import by_batch, materialise, prepare, table

NAME = "op9_cutting_stock"
ORACLE_SQL = None  # tests check the round trip, the fill against the material bound and tiny cases by brute force

WINDOW = 1024
SLICE = 1 << 19  # bytes of text encoded at a time (a longer document stands alone): bounds what a Python worker holds


def piece_starts(n_tokens: int, window: int = WINDOW) -> list[int]:
    """Where a document of ``n_tokens`` is cut: every window, and at half a window in a longer rest."""
    rest = n_tokens % window
    cut = list(range(0, n_tokens, window))
    return cut + [n_tokens - rest + window // 2] if rest > window // 2 else cut


def pieces(docs: DataFrame, encoder_args: tuple, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` for every piece of every document."""
    def kernel(batch):
        rows: list[tuple[int, int, int, int, int]] = []
        end = np.array([end_id], "<u4")
        for first, ids, offs in tokenids.encoder(*encoder_args).encode(batch.column("text"), SLICE):
            ids = ids.astype("<u4", copy=False)
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                whole = np.concatenate([ids[a:b], end])
                cut = piece_starts(len(whole), window)
                for s, e in zip(cut, cut[1:] + [len(whole)]):
                    rows.append((first + k, s, e - s, zlib.crc32(whole[s:e]), len(whole)))
        doc, *cols = np.array(rows, np.int64).T
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c) for c in cols)],
                                          ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(by_batch(kernel), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))


def best_pattern(size: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: (value, copies of each size) of the best multiset of ascending sizes."""
    total = np.zeros(room + 1)
    take = np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        total[c] = total[c - 1]
        k = fits[c]
        if k:
            gain = total[c - size[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > total[c] + 1e-12:
                total[c], take[c] = gain[i], i
    copies = np.zeros(len(size))
    c = room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            copies[take[c]] += 1
            c -= int(size[take[c]])
    return float(total[room]), copies


def solve_patterns(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3,
                   max_columns: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution of the LP by column generation: (patterns as columns, uses of each).

    Starts from one pattern for each size (as many copies as fit).  Stops when no pattern has a
    price above 1, when the objective is within ``gap`` of the material bound or of Farley's dual
    bound, or after ``max_columns`` (any basis is a feasible plan, only less tight)."""
    per = np.floor(room / size)
    basis, inverse = np.diag(per), np.diag(1 / per)
    demand = demand + 1e-6 * (1 + np.arange(len(size)) % 7)  # no ties between rows: no cycling
    use, dual = demand / per, 1 / per
    material = (size * demand).sum() / room
    for k in range(max_columns):
        if k % 64 == 63:  # a Newton step on the inverse: rounding errors of the updates do not pile up
            inverse = 2 * inverse - np.einsum("ij,jk,kl->il", inverse, basis, inverse, optimize=["einsum_path", (0, 1), (0, 1)])
            use, dual = np.maximum(inverse @ demand, 0), inverse.sum(0)
        value, column = best_pattern(size, dual, room)
        objective = float(use.sum())
        if value <= 1 + 1e-9 or objective <= max(material, objective / value) * (1 + gap):
            break
        step = inverse @ column
        ratio = np.full(len(size), np.inf)
        ok = step > 1e-7
        ratio[ok] = use[ok] / step[ok]
        r = int(ratio.argmin())
        row = inverse[r] / step[r]
        use = np.maximum(use - ratio[r] * step, 0)
        use[r] = ratio[r]
        inverse = inverse - np.outer(step, row)
        inverse[r] = row
        dual = dual + (1 - value) * row
        basis[:, r] = column
    return basis, use


def pack_lengths(histogram: np.ndarray, window: int = WINDOW, quantum: int = 4) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, longest first; number of such sequences)] that hold exactly
    ``histogram[w]`` pieces of each length w < window.

    The linear program sees lengths in classes of ``quantum`` (rounded up); places are exact."""
    room = window // quantum
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    klass = -(-np.arange(len(left)) // quantum)
    by_class = np.bincount(klass, weights=left, minlength=room + 1)
    size = np.flatnonzero(by_class)
    plan = []
    if len(size):
        basis, use = solve_patterns(size, by_class[size], room)
        for k in np.argsort(-use, kind="stable"):
            n = int(use[k] + 1e-6)
            classes = np.repeat(size, basis[:, k].astype(np.int64))[::-1].tolist()
            while n > 0:  # each round fixes exact lengths and repeats them while there are enough
                chosen: dict[int, int] = {}
                for c in classes:
                    w = next((w for w in range(min(c * quantum, len(left) - 1), (c - 1) * quantum, -1)
                              if left[w] > chosen.get(w, 0)), 0)
                    if w:
                        chosen[w] = chosen.get(w, 0) + 1
                if sum(chosen.values()) < len(classes):
                    break  # rounding has used these up elsewhere
                times = min(n, min(int(left[w]) // c for w, c in chosen.items()))
                for w, c in chosen.items():
                    left[w] -= c * times
                plan.append(([w for w in sorted(chosen, reverse=True) for _ in range(chosen[w])], times))
                n -= times
    open_at: list[list[list[int]]] = [[] for _ in range(window + 1)]  # sequences by free places
    for w in range(len(left) - 1, 0, -1):
        for _ in range(int(left[w])):
            r = next((r for r in range(w, window) if open_at[r]), window)
            seq = open_at[r].pop() if r < window else []
            if r == window:
                plan.append((seq, 1))
            seq.append(w)
            open_at[r - w].append(seq)
    return plan


def slots(plan: list[tuple[list[int], int]], first_sequence: int = 0) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, copies, first offset), sorted by length
    and rank: pieces of one length fill the plan's places in this order."""
    rows, used, seq = [], {}, first_sequence
    for lengths, times in plan:
        offset = 0
        for w in dict.fromkeys(lengths):
            copies = lengths.count(w)
            rows.append((w, used.get(w, 0), seq, times, copies, offset))
            used[w] = used.get(w, 0) + copies * times
            offset += copies * w
        seq += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, encoder_args: tuple, end_id: int = 0, window: int = WINDOW, bucket_rows: int = 20_000) -> DataFrame:
    """One row for each piece; see the module text."""
    cut = materialise(pieces(docs, encoder_args, end_id, window), "pieces")
    buckets = max(256, -(-cut.count() // bucket_rows))
    t = cut.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, start, length, ids_crc32), {buckets}L)"))
    sums = t.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for w, n in sums.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        histogram[w] = n
    n_full = int(histogram[window])
    plan = [([window], n_full)] * (n_full > 0) + pack_lengths(histogram[:window], window)
    place = slots(plan)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rank0 = sums.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    in_bucket = Window.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (t.withColumn("r", F.row_number().over(in_bucket) - 1).join(rank0, ["bucket", "length"])
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("r") + F.col("rank0")).alias("rank")))
    wide = int(histogram.max()) + 1
    keys = place[:, 0] * wide + place[:, 1]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def kernel(batch):
        w, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        _, rank_0, seq, _, copies, off = place[np.searchsorted(keys, w * wide + rank, "right") - 1].T
        r = rank - rank_0
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:5]), pa.array(seq + r // copies),
                                           pa.array(off + (r % copies) * w)], names)

    return ranked.mapInArrow(by_batch(kernel), ", ".join(f"{c} long" for c in names))


def query(spark, sf_dir):
    prepare(spark)
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenids.byte_bpe())
