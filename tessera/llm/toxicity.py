"""Toxic passages by maximum-scoring segments (operator 4).

* Token log-odds: counts of hashed tokens (``BUCKETS`` of them) in labelled toxic and clean
  documents and in the whole corpus; the corpus counts are the informative Dirichlet prior of
  both classes.  A token's log-odds are shrunk to zero by ``shrink`` of their standard
  deviations and every token costs ``drift``, so the expected score of clean text is negative.
* Segments: Ruzzo and Tompa's linear scan finds all maximal scoring segments of a document
  (only tokens with positive scores need a step; the stretches between are prefix sums).
* Calibration: scores of clean text follow an extreme-value law (Karlin and Altschul):
  E = K m exp(-lambda S) segments of score S or more are expected in m tokens.  lambda solves
  sum p(s) exp(lambda s) = 1 over clean tokens; ln K comes from the mean best segment of clean
  fitting documents.  A document's evidence is the sum of -ln E over its segments with E < 1.
* A logistic curve of ln(1 + evidence), fitted on a histogram over the fitting documents, turns
  the evidence into the score (0 to 1).

Bounds: each partition sends at most BUCKETS count rows; the model is one float for each bucket.
Labels to learn from: all outside the held-out fold, or a hash sample of about ``max_labelled``.

Nulls and edge cases: a null or empty text has no segment and gets the curve's value at zero
evidence; null ids keep their row and are never learned from; repeated rows are scored each;
without labels of both classes every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, fitting_labels, id_remainder, label_of, long_column, materialise, prepare, table

NAME = "op4_toxic_segments"
ORACLE_SQL = None  # tests hold the whole query against a plain Python version and held-out labels

BUCKETS = 1 << 18
TOKEN = np.zeros(256, bool)
TOKEN[list(b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
TOKEN[128:] = True
_TOP = np.uint64(64 - 18)
EULER = 0.5772156649015329


def _scan(batch):
    ids = long_column(batch, "doc_id")
    buf, offs = B.text_buffer(batch.column("text"))
    for i, j in B.slices(offs):
        b, o = B.LOWER[buf[offs[i]:offs[j]]], offs[i:j + 1] - offs[i]
        s, e = B.runs(TOKEN[b], o)
        yield i, j, ids[i:j], (B.span_hashes(b, s, e) >> _TOP).astype(np.int64), B.owner(o, s), s, e, o


def count_tokens(docs: DataFrame, fit_ids: np.ndarray, fit_y: np.ndarray) -> np.ndarray:
    """(3, BUCKETS) token counts: clean and toxic fitting documents, all documents."""
    def run(batches):
        total = np.zeros((3, BUCKETS), np.int64)
        for batch in batches:
            for _, _, ids, token, doc, *_ in _scan(batch):
                y = label_of(ids, fit_ids, fit_y)[doc]
                total[2] += np.bincount(token, minlength=BUCKETS)
                for k in (0, 1):
                    total[k] += np.bincount(token[y == k], minlength=BUCKETS)
        at = np.flatnonzero(total[2])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(t[at]) for t in total)],
                                             ["bucket", "clean", "toxic", "every"])

    rows = (docs.mapInArrow(run, "bucket int, clean long, toxic long, every long").groupBy("bucket")
            .agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "every"))).toArrow())
    out = np.zeros((3, BUCKETS), np.int64)
    for k, c in enumerate(("clean", "toxic", "every")):
        out[k, rows["bucket"].to_numpy()] = rows[c].to_numpy()
    return out


def log_odds(counts: np.ndarray, shrink: float = 2.0, drift: float = 0.5) -> np.ndarray:
    """Shrunk toxic-to-clean log-odds of each bucket, less the drift."""
    clean, toxic, every = counts.astype(np.float64)
    n0, n1 = clean.sum(), toxic.sum()
    if not n0 or not n1:
        return np.full(BUCKETS, -drift)
    strength = min(n0, n1)
    prior = strength * every / every.sum() + 0.01
    mass = prior.sum()
    odds = lambda y, n: np.log((y + prior) / (n + mass - y - prior))
    delta = odds(toxic, n1) - odds(clean, n0)
    sd = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(delta) * np.maximum(np.abs(delta) - shrink * sd, 0) - drift


def decay(weights: np.ndarray, clean: np.ndarray) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1 over clean tokens (bisection)."""
    p = (clean + 1e-3) / (clean + 1e-3).sum()
    if weights.max() <= 0 or (p * weights).sum() >= 0:
        return 1.0
    value = lambda x: float((p * np.exp(x * weights)).sum()) - 1
    lo, hi = 0.0, 1.0
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def maximal_segments(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score).  ``at``: tokens with a
    positive score, ascending; ``left``/``right``: prefix sums before and after each."""
    first, last, low, high, link = [], [], [], [], []
    for k in range(len(at)):
        a, z, lo, hi = k, k, left[k], right[k]
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                first.append(a), last.append(z), low.append(lo), high.append(hi), link.append(j)
                break
            a, lo = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
    return [(int(at[a]), int(at[z]), float(h - l)) for a, z, l, h in zip(first, last, low, high)]


def scan(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, best, passages`` (byte spans and scores of all maximal segments: which of them
    count is known only after K)."""
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def kernel(batch):
        n_tokens, best, passages = [], [], []
        for i, j, _, token, doc, s, e, o in _scan(batch):
            w = weights[token]
            total = np.concatenate([[0.0], np.cumsum(w)])
            first = B.first_of_doc(doc, j - i)
            hot = np.flatnonzero(w > 0)
            cut = np.searchsorted(hot, first)
            for d in range(j - i):
                m = int(first[d + 1] - first[d])
                at = hot[cut[d]:cut[d + 1]]
                zero = total[first[d]]
                found = maximal_segments(at, (total[at] - zero).tolist(), (total[at + 1] - zero).tolist())
                n_tokens.append(m)
                best.append(max((x[2] for x in found), default=0.0))
                passages.append([{"start": int(s[a] - o[d]), "end": int(e[z] - o[d]), "score": x} for a, z, x in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_tokens, pa.int64()),
                                           pa.array(best, pa.float64()), pa.array(passages, pa.list_(passage))],
                                          ["doc_id", "n_tokens", "best", "passages"])

    return docs.mapInArrow(by_batch(kernel), "doc_id long, n_tokens long, best double, "
                                             "passages array<struct<start:long,end:long,score:double>>")


def logistic(x: np.ndarray, y1: np.ndarray, y0: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(intercept, slope) by Newton steps over counts of toxic (y1) and clean (y0) at each x.
    The ridge keeps the slope finite on separable classes."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        n = y0 + y1
        grad = design.T @ (y1 - n * p) - ridge * np.array([0.0, beta[1]])
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge])
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, max_labelled: int = 1_000_000) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence, passages`` for every document; learns from
    labels of documents whose crc32(id) mod ``held_out_of`` is not 0."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learn = labels.where(id_remainder("doc_id", held_out_of) > 0).select("doc_id", "toxic")
    fit_ids, fit_y = fitting_labels(learn, "toxic", max_labelled)
    counts = count_tokens(docs, fit_ids, fit_y)
    weights = log_odds(counts)
    lam = decay(weights, counts[0])
    found = materialise(scan(docs, weights), "segments")
    known = found.join(learn.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id")
    shift = known.where("y = 0 and n_tokens > 0").agg(F.avg(lam * F.col("best") - F.log("n_tokens"))).first()[0]
    log_k = (shift if shift is not None else 0.0) - EULER
    size = F.log(F.greatest("n_tokens", F.lit(1)).cast("double"))
    evidence = F.aggregate("passages", F.lit(0.0), lambda t, p: t + F.greatest(F.lit(0.0), lam * p["score"] - size - log_k))
    bins = (known.select("y", F.round(F.log1p(evidence), 2).alias("x")).groupBy("x")
            .agg(F.sum(F.col("y").cast("double")).alias("y1"), F.sum(1.0 - F.col("y")).alias("y0")).toPandas())
    out = found.withColumn("evidence", evidence).withColumn("held_out", id_remainder("doc_id", held_out_of) == 0)
    if len(bins) and bins["y1"].sum() and bins["y0"].sum():
        a, b = logistic(bins["x"].to_numpy(float), bins["y1"].to_numpy(float), bins["y0"].to_numpy(float))
        out = out.withColumn("score", 1 / (1 + F.exp(-(a + b * F.log1p("evidence")))))
    else:
        out = out.withColumn("score", F.lit(0.0))
    significant = F.filter("passages", lambda p: lam * p["score"] - size - log_k > 0)  # E < 1
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
                      significant.alias("passages"))


def query(spark, sf_dir):
    prepare(spark)
    out = toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
