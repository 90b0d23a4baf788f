"""Quality rules by a hashed n-gram log-likelihood ratio (operator 2).

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams (words as written, so
shouting and glued symbols count): the trusted target, i.e. labelled documents of quality 1,
and the raw corpus, i.e. every document.  A document's score is the mean over its n-grams of
ln p_target - ln p_raw; it is kept if it passes the base rules and its score reaches the
threshold.  The threshold is fixed by the labelled documents: the midpoint of the mean scores
of the two classes (``fallback`` if a class is missing), so the verdict of a document depends
on nothing but its text and the two count tables.

Bounds: counts are summed in numpy within each partition and leave it as at most BUCKETS rows;
the model is one float for each bucket.  Labelled ids to learn from: all, or a hash sample of
about ``max_labelled`` (10^6 ids of 8 bytes); corpus counts always cover every document.

Nulls and edge cases: a null text has no words (base_failed); a null id keeps its row; repeated
rows are scored each; without labels the target equals no document, all ratios are smoothed to
one constant and the base rules decide (threshold ``fallback``); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, fitting_labels, label_of, long_column, materialise, prepare, table

NAME = "op2_quality_llr"
ORACLE_SQL = None  # the hash multinomials have no SQL form; tests hold it against a plain Python version

BUCKETS = 1 << 16
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_TOP = np.uint64(64 - 16)


def per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def base_counts(buf, offs, h, doc):
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n = len(offs) - 1
    word = ~B.SEPARATOR[buf]
    word_chars = per_doc(word & ((buf & 0xC0) != 0x80), offs)
    n_symbols = per_doc(SYMBOLS[buf], offs)
    s, e = B.runs(buf != 10, offs)
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(word, out=seen[1:])
    full = seen[e] > seen[s]
    s, e = s[full], e[full]
    lines = B.owner(offs, s)
    d, _ = B.distinct_per_doc(lines, B.span_hashes(buf, s, e))
    n_dup_lines = np.bincount(lines, minlength=n) - np.bincount(d, minlength=n)
    w, at = B.windows(h, doc, 3)
    key = B.mix(w + doc[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    twice = at[order[same[1:] | same[:-1]]]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[twice + k] = True
    n_repeat = np.bincount(doc[covered], minlength=n)
    return word_chars, n_symbols, n_dup_lines, n_repeat


def ngrams(h, doc):
    """(bucket, document) of every word and of every pair of neighbouring words."""
    pair, at = B.windows(h, doc, 2)
    return (np.concatenate([h >> _TOP, pair >> _TOP]).astype(np.int64), np.concatenate([doc, doc[at]]))


def _scan(batch):
    """Slices of a batch: (ids, buf, offs, word hashes, documents of the words)."""
    ids = long_column(batch, "doc_id")
    buf, offs = B.text_buffer(batch.column("text"))
    for i, j in B.slices(offs):
        b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        s, e, doc = B.words(b, o)
        yield i, j, ids[i:j], b, o, B.span_hashes(b, s, e), doc


def count_ngrams(docs: DataFrame, fit_ids: np.ndarray, fit_y: np.ndarray) -> np.ndarray:
    """(2, BUCKETS) n-gram counts: the raw corpus, the target documents."""
    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for _, _, ids, _, _, h, doc in _scan(batch):
                bucket, own = ngrams(h, doc)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                trusted = label_of(ids, fit_ids, fit_y) == 1
                total[1] += np.bincount(bucket[trusted[own]], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])],
                                             ["bucket", "raw", "target"])

    rows = (docs.mapInArrow(run, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    out = np.zeros((2, BUCKETS), np.int64)
    at = rows["bucket"].to_numpy()
    out[0, at], out[1, at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    return out


def ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    raw, target = counts.astype(np.float64) + smoothing
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, llr: np.ndarray) -> DataFrame:
    """Base counts and the mean log ratio (``llr``; null without words) of every document."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]

    def kernel(batch):
        parts = []
        for i, j, _, b, o, h, doc in _scan(batch):
            n_words = np.bincount(doc, minlength=j - i)
            bucket, own = ngrams(h, doc)
            total = np.bincount(own, weights=llr[bucket], minlength=j - i)
            n = np.bincount(own, minlength=j - i)
            cols = [n_words, *base_counts(b, o, h, doc)]
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), *(pa.array(c.astype(np.int64)) for c in cols),
                 pa.array(total / np.maximum(n, 1), mask=n == 0)], names))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return docs.mapInArrow(by_batch(kernel), "doc_id long, n_words long, word_chars long, n_symbols long, "
                                             "n_dup_lines long, n_repeat_words long, llr double")


def quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 1_000_000, min_words: int = 50,
            max_repeat_percent: int = 50, fallback: float = -0.5) -> DataFrame:
    """Verdict of every document; see the module text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fit_ids, fit_y = fitting_labels(labels, "quality", max_labelled)
    scored = materialise(score(docs, ratios(count_ngrams(docs, fit_ids, fit_y))), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    means = {r[0]: r[1] for r in (scored.where(~failed).join(labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.max("quality").alias("y")), "doc_id").where("y is not null")
             .groupBy("y").agg(F.avg("llr"))).collect()}
    threshold = (means[0] + means[1]) / 2 if {0, 1} <= means.keys() else fallback
    return (scored.withColumn("base_failed", failed).withColumn("threshold", F.lit(float(threshold)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)))


def query(spark, sf_dir):
    prepare(spark)
    return quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
