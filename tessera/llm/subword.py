"""Quality classifier of supervised subword embeddings (operator 12).

A document is the bag of its words, of its pairs of neighbouring words, and of its words' character
n-grams (``GRAMS`` bytes long, with the blanks around a word as its edges), as written: case, digits
and glued symbols count.  A word that occurred up to ``BACK`` words before is besides a feature "the
same again", whichever word it is, so that repetition is learned from words never seen.  Each is
hashed into one of ``BUCKETS`` vectors of ``DIM`` numbers; a document's vector is their average and a
softmax layer turns it into the probabilities of the two classes.  Vectors and layer are learned
together by stochastic gradient descent in numpy: one document a step, in a fixed shuffled order,
steps scaled by each vector's past gradients (AdaGrad), so that features of few documents
learn as fast as frequent ones.

Work in Spark: one pass turns the sampled labelled documents into (bucket, count) lists; the driver
fits the model on them; one pass scores every document.  For scoring, the softmax of two classes is a
logistic function of the difference of the layer's columns, so each bucket's vector becomes one
number (its product with that difference) and a document's score needs only their average.
``vectors`` gives the documents' average vectors themselves.

Bounds: the sample is about ``max_labelled`` labelled documents, in hash order as many as have
``max_features`` (bucket, count) entries together (six bytes each): what the driver holds does not grow
with the corpus.  The model is BUCKETS x DIM floats, and one float a bucket travels for scoring.

Nulls and edge cases: a null, empty or blank text has no features, its average is the zero vector and
its score the layer's bias; null ids keep their row and are never learned from; repeated rows are
scored each; repeated labels of one document give their maximum; without labels of both classes
every score is the share of label 1 (0.5 without any label); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, fitting_labels, id_remainder, label_of, long_column, materialise, prepare, release, table

NAME = "op12_subword_quality"
ORACLE_SQL = None  # a model trained by gradient descent has no SQL form; tests hold it against held-out labels

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
BACK = 3
SLICE = 1 << 18
_TOP = np.uint64(64 - 17)
_PLACE = np.random.default_rng(12).integers(1, 1 << 62, max(GRAMS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def features(column: pa.Array):
    """Slices of a text column: (first row, last row, buckets, their rows; not sorted)."""
    buf, offs = B.text_buffer(column)
    for i, j in B.slices(offs, SLICE):
        # a blank before, between and after the texts
        size = np.diff(offs[i:j + 1])
        place = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.full(place[-1] + 1, 0x20, np.uint8)
        text[np.arange(offs[j] - offs[i]) + np.repeat(np.arange(j - i), size) + 1] = buf[offs[i]:offs[j]]
        word = ~B.SEPARATOR[text]
        text[~word] = 0x20
        s, e = B.runs(word, np.array([0, len(text)]))
        own = np.append(np.repeat(np.arange(j - i, dtype=np.int32), size + 1), np.int32(j - i - 1))
        h, doc = B.span_hashes(text, s, e), own[s]
        pair, first = B.windows(h, doc, 2)
        out, at = [h >> _TOP, pair >> _TOP], [doc, doc[first]]
        for lag in range(1, min(BACK + 1, len(h))):
            again = np.flatnonzero((h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag]))
            out.append(np.full(len(again), lag, np.uint64))
            at.append(doc[again])
        inside = np.zeros(len(text) + 1, np.int32)
        np.cumsum(word, out=inside[1:])
        wide = text.astype(np.uint64)
        part = np.empty_like(wide)
        for n in GRAMS:
            most = len(text) - n + 1
            if most <= 0:
                break
            # windows whose bytes are all of one word, or one blank at either end of it
            full = inside[n - 1:n - 1 + most] - inside[1:most + 1] == n - 2
            h = wide[:most] * _PLACE[0]
            h += np.uint64(n)
            for k in range(1, n):
                h += np.multiply(wide[k:most + k], _PLACE[k], out=part[:most])
            h = h[full]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # (enough mixing for the top bits)
                h ^= np.right_shift(h, np.uint64(shift), out=part[:len(h)])
                h *= np.uint64(factor)
            h >>= _TOP
            out.append(h)
            at.append(own[1:most + 1][full])
        yield i, j, np.concatenate(out).view(np.int64), np.concatenate(at)


def count_features(docs: DataFrame, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    """``doc_id, y, n, buckets, counts`` (little-endian int32 and uint16) of the documents named."""
    def kernel(batch):
        rows = batch.filter(pa.array(label_of(long_column(batch, "doc_id"), ids, y) >= 0))
        if not rows.num_rows:
            return None
        own, label = long_column(rows, "doc_id"), label_of(long_column(rows, "doc_id"), ids, y)
        buckets, counts = [], []
        for i, j, bucket, row in features(rows.column("text")):
            key, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
            for a, z in zip(cut[:-1], cut[1:]):
                buckets.append((key[a:z] % BUCKETS).astype("<i4").tobytes())
                counts.append(np.minimum(n[a:z], 65535).astype("<u2").tobytes())
        size = np.array([len(x) // 4 for x in buckets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(label.astype(np.int32)), pa.array(size), pa.array(buckets, pa.binary()),
                                           pa.array(counts, pa.binary())], ["doc_id", "y", "n", "buckets", "counts"])

    return docs.mapInArrow(by_batch(kernel), "doc_id long, y int, n long, buckets binary, counts binary")


class Model:
    """Bucket vectors, softmax layer and its bias."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        self.vectors = g.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.layer = np.zeros((DIM, 2))
        self.bias = np.zeros(2)

    def probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.layer + self.bias
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def fit(self, samples: list, y: np.ndarray, epochs: int, rate: float, seed: int = 6) -> "Model":
        """``samples``: (buckets, counts) of each document."""
        g = np.random.default_rng(seed)
        past, past_layer, past_bias = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
        share = np.clip(np.bincount(y, minlength=2) / len(y), 1e-3, 1)
        self.bias = np.log(share)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for k in g.permutation(len(samples)):
                at, count = samples[k]
                if not len(at):
                    continue
                part = (count / count.sum()).astype(np.float32)
                hidden = part @ self.vectors[at]
                error = self.probabilities(hidden)
                error[y[k]] -= 1
                toward = (self.layer @ error).astype(np.float32)
                grad = np.outer(hidden, error)
                past_layer += grad ** 2
                past_bias += error ** 2
                self.layer -= step * grad / np.sqrt(past_layer)
                self.bias -= 0.1 * step * error / np.sqrt(past_bias)
                past[at] += (part * part) * float(toward @ toward) / DIM
                self.vectors[at] -= (step * part / np.sqrt(past[at]))[:, None] * toward
        return self

    def pulls(self) -> np.ndarray:
        """Each bucket's part of the log-odds of class 1."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, flag: str, max_labelled: int, max_features: int, epochs: int, rate: float) -> Model | float:
    """The model, or the share of label 1 if there is nothing to tell apart."""
    ids, y = fitting_labels(labels, flag, max_labelled)
    counted = materialise(count_features(docs, ids, y).dropDuplicates(["doc_id"]), "features")
    # in hash order, as many documents as hold max_features entries
    sizes = counted.select("doc_id", "n", F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    chosen = sizes["doc_id"].to_numpy()[np.cumsum(sizes["n"].to_numpy()) <= max_features]
    named = np.sort(chosen)

    def pick(batch):
        return batch.filter(pa.array(label_of(long_column(batch, "doc_id"), named, np.ones(len(named), np.int8)) == 1))

    rows = counted.mapInArrow(by_batch(pick), counted.schema).toArrow().sort_by("doc_id")
    release(counted)
    y = rows["y"].to_numpy()
    if not y.any() or y.all():
        return float(y.mean()) if len(y) else 0.5
    samples = [(np.frombuffer(a, "<i4"), np.frombuffer(c, "<u2").astype(np.float32))
               for a, c in zip(rows["buckets"].to_pylist(), rows["counts"].to_pylist())]
    return Model().fit(samples, y, epochs, rate)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id, n_features, score``."""
    flat = None if isinstance(model, float) else (model.pulls(), float(model.bias[1] - model.bias[0]))

    def kernel(batch):
        n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for i, j, bucket, row in features(batch.column("text")):
            n[i:j] = np.bincount(row, minlength=j - i)
            if flat:
                total[i:j] = np.bincount(row, flat[0][bucket], minlength=j - i)
        value = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + flat[1], -500, 500))) if flat else np.full(len(n), model)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(value)], ["doc_id", "n_features", "score"])

    return docs.mapInArrow(by_batch(kernel), "doc_id long, n_features long, score double")


def vectors(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, vector``: the average of each document's feature vectors."""
    table_of = model.vectors

    def kernel(batch):
        out = np.zeros((batch.num_rows, DIM))
        for i, j, bucket, row in features(batch.column("text")):
            n = np.maximum(np.bincount(row, minlength=j - i), 1)
            for d in range(DIM):
                out[i:j, d] = np.bincount(row, table_of[bucket, d], minlength=j - i) / n
        flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DIM), pa.array(out.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), flat], ["doc_id", "vector"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_batch(kernel), "doc_id long, vector array<double>")


def classify(docs: DataFrame, labels: DataFrame, flag: str = "quality", held_out_of: int = 5, threshold: float = 0.3,
             max_labelled: int = 5_000, max_features: int = 12_000_000, epochs: int = 4, rate: float = 0.1) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_features`` of every document; learns from labels of
    documents whose crc32(id) mod ``held_out_of`` is not 0."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learn = labels.where(id_remainder("doc_id", held_out_of) > 0).select("doc_id", flag)
    model = fit(docs, learn, flag, max_labelled, max_features, epochs, rate)
    out = score(docs, model).withColumn("held_out", id_remainder("doc_id", held_out_of) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_features")


def query(spark, sf_dir):
    prepare(spark)
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
