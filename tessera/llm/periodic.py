"""Periodic runs of words by an online sparse diagonal DP (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(``min_words``, 2 q) that no neighbouring word extends with period q.

The DP walks along a text's words.  A word that occurred q words earlier lengthens the match of lag q
(its diagonal) by one; a diagonal that is not lengthened ends, and if its match is long enough it
emits its run there and then.  It is kept sparse by what a run needs: at lag q at least q words
must match, so

* at lags below ``DENSE`` the diagonals are walked word by word;
* at lags from b to 2 b it is enough to walk in steps of b / 2 words, whose block of b / 2 words must
  have occurred q words earlier: every run holds one such block.  A block's earlier occurrences in
  that range lengthen their diagonals by a block; a diagonal that ends is lengthened word by word
  over less than one block on either side (by prefix hashes, so in log b steps).

Texts none of whose blocks of ``DENSE / 2`` words occurs twice skip the second part.  A step looks at
no more than b lags, so a text of n words costs at most 2 n entries for each doubling of b, whatever
repeats in it: a text of one word repeated is no special case.  A stretch whose smallest period is
shorter is found on that period's diagonal with the same ends, so of equal ends the least lag stays.

Each document is worked on where its row lies: no shuffle.  A word's identity is its 64-bit hash.

Nulls and edge cases: a null, empty or blank text has no words and no runs; a null id keeps its row;
repeated rows come out repeated; a text of many million words is worked on alone, in memory linear
in its words; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, prepare, table

NAME = "op13_periodic_runs"
ORACLE_SQL = None  # matching along diagonals has no SQL form; tests hold it against brute force over all lags

DENSE = 16
SLICE = 1 << 19  # bytes of text worked on at a time (a longer document stands alone)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[0::2], edge[1::2]


class Prefixes:
    """Hashes of any window of a sequence of word hashes."""

    def __init__(self, word: np.ndarray):
        power = np.full(len(word) + 1, _STEP)
        back = np.full(len(word) + 1, _BACK)
        power[0] = back[0] = 1
        power, self.back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        self.total = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * power[:-1], out=self.total[1:])

    def window(self, at: np.ndarray, size) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.back[at]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on (or back from them) are equal, up to ``most``: bisection."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            x, y = (a, b) if forward else (a - mid, b - mid)
            same = self.window(x, mid) == self.window(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _sparse_diagonals(word: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """(start, words that match, lag) of the ended diagonals of lags from DENSE on.  ``first``: document
    offsets; words of different documents never match (their hashes carry the document)."""
    hashes, n = Prefixes(word), len(word)
    doc_end = np.repeat(first[1:], np.diff(first))
    doc_begin = np.repeat(first[:-1], np.diff(first))
    longest = int(np.diff(first).max(initial=0))
    out, b = [], DENSE
    while 2 * b <= longest:
        k = b // 2
        block = hashes.window(np.arange(n - k + 1), k)
        step = np.arange(n)
        step = step[((step - doc_begin) % k == 0) & (step + b + k <= doc_end)]  # an occurrence b words on must fit
        order = np.argsort(block, kind="stable")  # places of equal blocks ascend
        kind = np.cumsum(np.append(False, block[order][1:] != block[order][:-1])) if n >= k else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = kind
        key = kind * (2 * n) + order  # ascending
        lo = np.searchsorted(key, rank[step] * (2 * n) + step + b)
        hi = np.searchsorted(key, rank[step] * (2 * n) + step + 2 * b)
        count = hi - lo
        at = np.repeat(step, count)
        lag = order[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(at))] - at
        # blocks that follow each other on a diagonal are one match
        walk = np.lexsort((at, lag))
        at, lag = at[walk], lag[walk]
        if len(at):
            new = np.append(True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + k))
            head = np.flatnonzero(new)
            start, lag = at[head], lag[head]
            stop = at[np.append(head[1:], len(at)) - 1] + k
            left = hashes.reach(start, start + lag, np.minimum(k, start - doc_begin[start]), False)
            right = hashes.reach(stop, stop + lag, np.minimum(k, doc_end[start] - lag - stop), True)
            out.append(np.stack([start - left, stop + right - start + left, lag], 1))
        b *= 2
    return out


def runs_of(word: np.ndarray, doc: np.ndarray, n_docs: int, min_words: int = 12) -> np.ndarray:
    """(document, start, length, period) of every run, sorted by these; starts count from the
    document's first word.  ``word``: word hashes; ``doc``: their documents, ascending."""
    first = B.first_of_doc(doc, n_docs)
    word = B.mix(word ^ B.mix(doc.astype(np.uint64) + np.uint64(1)))
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(1, min(DENSE, len(word))):
        s, e = _stretches(word[lag:] == word[:-lag])
        keep = e - s >= max(lag, min_words - lag)
        found.append(np.stack([s[keep], (e - s)[keep], np.full(keep.sum(), lag)], 1))
    # only documents with a block that occurs twice can have longer lags
    k = DENSE // 2
    block, at = B.windows(word, doc, k)
    order = np.argsort(block)
    twice = order[1:][block[order[1:]] == block[order[:-1]]]
    some = np.unique(doc[at[twice]])
    if len(some):
        pick = np.flatnonzero(np.isin(doc, some))
        size = (first[1:] - first[:-1])[some]
        offs = np.concatenate([[0], np.cumsum(size)])
        for part in _sparse_diagonals(word[pick], offs):
            part = part[part[:, 1] >= np.maximum(part[:, 2], min_words - part[:, 2])]
            part[:, 0] = pick[part[:, 0]] if len(part) else part[:, 0]
            found.append(part)
    s, match, lag = np.concatenate(found).T
    out = np.stack([doc[s] if len(s) else s, s, match + lag, lag], 1)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1]))]
    if len(out):  # equal ends: the least period
        out = out[np.append(True, (out[1:, 1] != out[:-1, 1]) | (out[1:, 2] != out[:-1, 2]))]
        out = out[np.lexsort((out[:, 3], out[:, 1]))]
        out[:, 1] -= first[out[:, 0]]
    return out


def dropped_words(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mask over all words: in a run, after its first period."""
    mark = np.zeros(int(first[-1]) + 1, np.int64)
    begin = first[runs[:, 0]] + runs[:, 1]
    np.add.at(mark, begin + runs[:, 3], 1)
    np.add.at(mark, begin + runs[:, 2], -1)
    return np.cumsum(mark[:-1]) > 0


def periodic_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row: the runs (start, length, period; by start, then
    period) and the words left when each run keeps its first period, joined by one blank."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def kernel(batch):
        buf, offs = B.text_buffer(batch.column("text"))
        count, lists, texts = [], [], []
        for i, j in B.slices(offs, SLICE):
            b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            s, e, doc = B.words(b, o)
            first = B.first_of_doc(doc, j - i)
            runs = runs_of(B.span_hashes(b, s, e), doc, j - i, min_words)
            gone, of = dropped_words(runs, first), np.searchsorted(runs[:, 0], np.arange(j - i + 1))
            data = b.tobytes()
            for d in range(j - i):
                left = data[o[d]:o[d + 1]].split()
                count.append(len(left))
                lists.append([{"start": x, "length": y, "period": z} for _, x, y, z in runs[of[d]:of[d + 1]].tolist()])
                if of[d] < of[d + 1]:
                    left = [left[w] for w in np.flatnonzero(~gone[first[d]:first[d + 1]])]
                texts.append(b" ".join(left))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()),
                                           pa.array(lists, pa.list_(run)), pa.array(texts, pa.binary()).cast(pa.string())], names)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(by_batch(kernel), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with the query's repetitions: with h = crc32(decimal id) and h % 10 = 0, every word
    from number a = (h / 10) % n on becomes the word a + (i - a) % p, p = 1 + (n - a) / (3 + (h / 10) % 8)."""
    def kernel(batch):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for k, d in enumerate(ids):
            h = zlib.crc32(str(d).encode()) if d is not None else 1
            if h % 10 == 0 and texts[k]:
                words = texts[k].encode().split()
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + x % p] for x in range(n - a)]).decode()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(by_batch(kernel), "doc_id long, text string"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's rows: the longest run and hashes of all of them."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    t = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(line, "").alias("lines"), "collapsed")
    length = -F.col("b.l")
    return t.select("doc_id", "n_runs", F.col("b.s").alias("start"), length.alias("length"), F.col("b.p").alias("period"),
                    F.floor(1000 * length / F.col("b.p")).cast("long").alias("exponent_milli"),
                    F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def query(spark, sf_dir):
    prepare(spark)
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents", "doc_id", "text"))))
