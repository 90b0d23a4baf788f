"""Document vectors and dimension reduction.

V1 (re-aimed): the default encoder needs no model file.  Tokens -> TF-IDF
weights (document frequencies by one grouped aggregate) -> a signed random
projection to ``dim`` dimensions whose signs are the bits of ``xxhash64(term)``
(so no projection matrix is stored or broadcast), summed for each document -> L2
normalisation.  The sum is linear in the weights, so a document is encoded where it is read, with the
idf of the most frequent terms at hand (``TABLE_TERMS``); what it leaves to a join are its rarer terms,
and only vectors of ``dim`` numbers are shuffled.  Any real sentence encoder plugs in
through ``embed_with`` (``mapInArrow``: one model load per task, fixed-size
batches).

V6/V7 (re-aimed): PCA from ``pyspark.ml`` on L2-normalised vectors, fitted on
the latest N rows and saved/loaded with the ML writer; V8 is the same with 2
or 3 components.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.functions import vectors as VF
from tessera.session import hold

DIM = 64
TABLE_TERMS = 1 << 20  # terms whose idf every task has at hand, at most (16 MB)


def fit_encoder(docs: DataFrame, text: str = "text") -> DataFrame:
    """V1, fit once: ``(term, idf)`` with idf = ln((N+1)/(df+1)) + 1 (Spark's IDF form), and one
    row with a null term that holds the idf of a term never seen, ln(N+1) + 1."""
    # (an outer explode: a plain one first filters by the size of the tokens and so cuts each text twice)
    terms = docs.select(TX.vectorizer_tokens(text).alias("t")).select(F.explode_outer(F.array_distinct("t")).alias("term"))
    terms = terms.filter(F.col("term").isNotNull())
    n = docs.agg(F.count(F.lit(1))).scalar()
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.ln((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return seen.unionByName(docs.agg((F.ln(F.count(F.lit(1)) + 1.0) + 1).alias("idf"))
                            .select(F.lit(None).cast("string").alias("term"), "idf"))


def tfidf_terms(docs: DataFrame, encoder: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, term, w)`` with w = tf * idf of a fitted encoder."""
    toks = docs.select(key, F.explode(TX.vectorizer_tokens(text)).alias("term"))
    tf = toks.groupBy(key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    unseen = encoder.filter(F.col("term").isNull()).select("idf").scalar()
    return (tf.join(encoder.filter(F.col("term").isNotNull()), "term", "left")
            .select(key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w")))


def project_terms(weights: DataFrame, key: str = "doc_id", dim: int = DIM, seed: int = 7) -> DataFrame:
    """Signed random projection of per-document term weights: ``(key, vec)``.

    One 64-bit ``xxhash64(term, seed + j)`` per term and 64 dimensions; bit k
    of it is the sign of dimension k.  A document's (hash, weight) rows meet in one
    shuffle and are summed in numpy, in the order of their hashes, then L2 normalised: 64
    sums in one aggregate make a method too long to be compiled."""
    nh = (dim + 63) // 64
    names = [f"h{j}" for j in range(nh)]
    hashed = weights.select(key, F.struct(*[F.xxhash64(F.col("term"), F.lit(seed + j)).alias(n) for j, n in enumerate(names)],
                                          F.col("w").alias("w")).alias("t"))
    key_type = weights.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            terms = batch.column("t")
            first = terms.offsets.to_numpy()
            flat = terms.flatten()
            hs, w = [flat.field(n).to_numpy(zero_copy_only=False) for n in names], flat.field("w").to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                a, b = first[k] - first[0], first[k + 1] - first[0]
                order = np.argsort(hs[0][a:b], kind="stable")
                mine = w[a:b][order]
                raw = []
                for h in hs:
                    bits = np.unpackbits(np.ascontiguousarray(h[a:b][order]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    raw.append(mine.sum() - 2.0 * (mine @ bits))
                raw = np.concatenate(raw)[:dim] / dim ** 0.5
                length = np.sqrt((raw * raw).sum())
                out.append(raw / length if length > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.list_(pa.float64()))], [key, "vec"])

    terms = hashed.groupBy(key).agg(F.collect_list("t").alias("t"))
    return terms.mapInArrow(run, f"{key} {key_type}, vec array<double>")


def _at_hand(encoder: DataFrame, seed: int, table_terms: int) -> tuple[np.ndarray, np.ndarray, float, float | None]:
    """The most frequent terms of a fitted encoder: their sorted hashes and idfs, the idf of an unseen
    term, and, where terms had to be left out, the largest idf that is in.  Terms of one idf are in or out
    together, so which are depends on the encoder alone."""
    of_idf = encoder.filter(F.col("term").isNotNull()).groupBy("idf").agg(F.count(F.lit(1)).alias("n")).toArrow()
    idf, n = of_idf["idf"].to_numpy(), of_idf["n"].to_numpy()  # (one row for each document frequency)
    idf, n = idf[order := np.argsort(idf)], n[order]
    fits = int(np.searchsorted(np.cumsum(n), table_terms, side="right"))
    unseen = encoder.filter(F.col("term").isNull()).select("idf").first()
    last = None if fits == len(idf) else float(idf[fits - 1]) if fits else -np.inf
    some = encoder.filter(F.col("term").isNotNull()) if last is None else encoder.filter(F.col("term").isNotNull() & (F.col("idf") <= F.lit(last)))
    rows = some.select(F.xxhash64("term", F.lit(seed)).alias("h"), "idf").toArrow()
    h, w = rows["h"].to_numpy(), rows["idf"].to_numpy()
    order = np.argsort(h, kind="stable")
    return h[order], w[order], np.nan if unseen is None or unseen[0] is None else float(unseen[0]), last


def _signed_sum(hashes: list[np.ndarray], w: np.ndarray, dim: int) -> np.ndarray:
    """The weights summed with the signs of their terms' hashes."""
    raw = []
    for h in hashes:
        bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        raw.append(w.sum() - 2.0 * (w @ bits))
    return np.concatenate(raw)[:dim] / dim ** 0.5


def _lists(rows: list, width: int) -> pa.Array:
    """list<double> rows of ``width`` numbers or null."""
    some = np.array([r is not None for r in rows], bool)
    flat = np.concatenate([r for r in rows if r is not None]) if some.any() else np.zeros(0)
    offsets = np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~some))


def _same_key(column: pa.Array) -> list[np.ndarray]:
    """Row numbers of each key of a batch (null is one key)."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def _encode_rows(docs: DataFrame, names: list[str], idf, last, key: str, text: str, dim: int, seed: int, one_each: bool) -> DataFrame:
    """``(key, _n, _raw, _rare)``: the rows of one key in a batch, their number, the sum of their terms at hand,
    and, where the table does not hold all terms, the other terms' hashes and counts.  A null key has no sum."""
    key_type = docs.schema[key].dataType.simpleString()
    rare_type = f"array<struct<{', '.join(f'{n}: bigint' for n in names)}, tf: bigint>>"
    rare_kind = pa.list_(pa.struct([(n, pa.int64()) for n in [*names, "tf"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, unseen = idf.value
        for batch in batches:
            keys, lists = batch.column(key), [batch.column(n) for n in names]
            first = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
            null = keys.is_null().to_numpy(zero_copy_only=False)
            groups = _same_key(keys)
            raws, rares = [], []
            for rows in groups:
                mine = rows[:1] if one_each else rows
                part = [np.concatenate([h[first[k]:first[k + 1]] for k in mine]) if len(mine) > 1 else h[first[mine[0]]:first[mine[0] + 1]] for h in flat]
                if null[rows[0]] or not len(part[0]):
                    raws.append(None)
                    rares.append(None)
                    continue
                u, at, tf = np.unique(part[0], return_index=True, return_counts=True)
                place = np.minimum(np.searchsorted(known, u), max(len(known) - 1, 0))
                held = known[place] == u if len(known) else np.zeros(len(u), bool)
                hashes = [h[at] for h in part]
                if last is None:
                    rares.append(None)
                else:
                    rares.append(pa.StructArray.from_arrays([pa.array(h[~held]) for h in hashes] + [pa.array(tf[~held].astype(np.int64))], [*names, "tf"]))
                    hashes, tf, place, held = [h[held] for h in hashes], tf[held], place[held], held[held]
                w = tf * (np.where(held, weight[place], unseen) if len(known) else np.full(len(tf), unseen))
                raws.append(_signed_sum(hashes, w, dim) if len(w) else np.zeros(dim))
            lead = pa.array([r[0] for r in groups], pa.int64())
            size = np.array([0 if r is None else len(r) for r in rares], np.int64)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                            pa.concat_arrays([r for r in rares if r is not None] or [pa.array([], rare_kind.value_type)]))
            count = pa.array([1 if one_each else len(r) for r in groups], pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(lead), count, _lists(raws, dim), rare.cast(rare_kind)], [key, "_n", "_raw", "_rare"])

    tokens = docs.select(key, TX.vectorizer_tokens(text).alias("_tokens"))
    signs = lambda j: F.transform("_tokens", lambda t: F.xxhash64(t, F.lit(seed + j)))
    hashed = tokens.select(key, *[signs(j).alias(n) for j, n in enumerate(names)])
    return hashed.mapInArrow(run, f"{key} {key_type}, _n bigint, _raw array<double>, _rare {rare_type}")


def _rare_sums(rows: DataFrame, encoder: DataFrame, names: list[str], last: float, unseen: float, key: str, dim: int, seed: int) -> DataFrame:
    """``(key, _raw)``: the sums of the terms that ``_encode_rows`` left out, by a join with the encoder."""
    key_type = rows.schema[key].dataType.simpleString()
    idf = encoder.filter(F.col("term").isNotNull() & (F.col("idf") > F.lit(last))).select(F.xxhash64("term", F.lit(seed)).alias(names[0]), "idf")
    idf = idf.groupBy(names[0]).agg(F.min("idf").alias("idf"))
    terms = rows.filter(F.col(key).isNotNull()).select(key, F.explode_outer("_rare").alias("t")).filter(F.col("t").isNotNull()).select(key, "t.*")
    w = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    of_key = (terms.join(idf, names[0], "left").select(key, F.struct(*names, w.alias("w")).alias("t"))
              .groupBy(key).agg(F.collect_list("t").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            hashes, w = [flat.field(n).to_numpy(zero_copy_only=False) for n in names], flat.field("w").to_numpy(zero_copy_only=False)
            out = []
            for k in range(batch.num_rows):
                part = slice(first[k], first[k + 1])
                order = np.lexsort((w[part], hashes[0][part]))
                out.append(_signed_sum([h[part][order] for h in hashes], w[part][order], dim))
            yield pa.RecordBatch.from_arrays([batch.column(key), _lists(out, dim)], [key, "_raw"])

    return of_key.mapInArrow(run, f"{key} {key_type}, _raw array<double>")


def apply_encoder(docs: DataFrame, encoder: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM,
                  seed: int = 7, one_each: bool = False, one_row: bool = False, table_terms: int | None = None) -> DataFrame:
    """V1, apply many: ``(key, vec)``, one row for each document (a null vector when it has no
    token).  A document's vector depends on it and the fitted table alone, not on its batch.  Rows that
    repeat a key are one document, whose vector each of them gets (``one_row``: one row for each key);
    ``one_each``: one of them is, with one row.  A null key has no vector.

    It is ``project_terms`` of ``tfidf_terms``, summed where the texts are read.  A term is known by its 64-bit hash, which
    also makes its signs.  ``encoder`` should be stored: it is read several times."""
    names = [f"h{j}" for j in range((dim + 63) // 64)]
    known, weight, unseen, last = _at_hand(encoder, seed, TABLE_TERMS if table_terms is None else table_terms)
    idf = docs.sparkSession.sparkContext.broadcast((known, weight, unseen))
    rows = _encode_rows(docs, names, idf, last, key, text, dim, seed, one_each)
    if one_each:
        rows = rows.dropDuplicates([key])
    if last is not None:
        rows = hold(rows, "encoded")
    sums = rows.select(key, "_n", "_raw")
    if last is not None:
        sums = sums.unionByName(_rare_sums(rows, encoder, names, last, unseen, key, dim, seed).withColumn("_n", F.lit(0).cast("bigint")))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("_raw")
            first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            flat = parts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out = []
            for k in range(batch.num_rows):
                raw = flat[first[k]:first[k + 1]]
                raw = raw[0] if len(raw) == 1 else np.sort(raw, axis=0).sum(0)  # (in an order that is the parts' own)
                length = np.sqrt((raw * raw).sum())
                out.append(raw / length if length > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_n"), _lists(out, dim)], [key, "_n", "vec"])

    whole = sums.groupBy(key).agg(F.sum("_n").alias("_n"), F.collect_list("_raw").alias("_raw"))
    vec = whole.mapInArrow(run, f"{key} {key_type}, _n bigint, vec array<double>")
    if one_each or one_row:
        return vec.select(key, "vec")
    return vec.select(key, "vec", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n"))).select(key, "vec")


def embed(docs: DataFrame, key: str = "doc_id", text: str = "text", dim: int = DIM, seed: int = 7) -> DataFrame:
    """V1 default encoder fitted on the documents themselves: ``(key, vec)``.  The documents are stored
    first: their texts, which may be costly to compose, are read to fit and to encode."""
    docs = hold(docs.select(key, text), "texts")
    return apply_encoder(docs, hold(fit_encoder(docs, text), "encoder"), key, text, dim, seed)


def embed_with(docs: DataFrame, load_model: Callable[[], object], key: str = "doc_id", text: str = "text",
               dim: int = DIM, batch_size: int = 32) -> DataFrame:
    """V1 with a pluggable encoder: ``load_model()`` returns an object with
    ``encode(list[str]) -> array (n, dim)``; loaded once per task, fed
    ``batch_size`` texts at a time (Arrow batches in, Arrow batches out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)  # (keys stay Arrow values: pandas would round large ones beside a null)
                vecs = model.encode(part.column(text).fill_null("").to_pylist())
                vecs = pa.array([list(map(float, v)) for v in vecs], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(key), vecs], [key, "vec"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {key_type}, vec array<double>")


def _unit(df: DataFrame, vec: str) -> DataFrame:
    """Adds ``_unit``, the L2-normalised vector (null if zero), by a norm column: inside the lambda the
    norm would be worked out for every element."""
    t = df.withColumn("_norm", VF.norm(F.col(vec)))
    unit = F.transform(F.col(vec).cast("array<double>"), lambda x: x / F.col("_norm"))
    return t.withColumn("_unit", F.when(F.col("_norm") > 0, unit)).drop("_norm")


def fit_reducer(df: DataFrame, k: int, vec: str = "vec", ts: str | None = None, n_train: int | None = None,
                key: str | None = None):
    """V6: PCA(k) fitted on the L2-normalised vectors (all of them; the
    latest ``n_train`` by ``ts``, ties by ``key``, only when asked for).  Returns a ``PCAModel`` (save with ``model.write()``)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    train = df
    if ts is not None and n_train is not None:
        train = df.orderBy(F.col(ts).desc(), *([key] if key else [])).limit(int(n_train))
    unit = _unit(train.select(F.col(vec)), vec).select(F.col("_unit").alias("u")).filter(F.col("u").isNotNull())
    train = unit.select(array_to_vector("u").alias("features"))
    return PCA(k=k, inputCol="features", outputCol="reduced_features").fit(train)


def reduce(df: DataFrame, model, vec: str = "vec", out: str = "reduced") -> DataFrame:
    """V7: apply a fitted (or loaded: ``PCAModel.load(path)``) reducer; one row out for each row in
    (null where the vector is missing or zero)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = _unit(df, vec)
    some = unit.filter(F.col("_unit").isNotNull())
    done = model.transform(some.withColumn(model.getInputCol(), array_to_vector("_unit")))
    done = done.withColumn("_reduced", vector_to_array(model.getOutputCol())).drop(model.getInputCol(), model.getOutputCol())
    none = unit.filter(F.col("_unit").isNull()).withColumn("_reduced", F.lit(None).cast("array<double>"))
    return done.unionByName(none).drop("_unit").withColumnRenamed("_reduced", out)


def layout(df: DataFrame, dims: int = 2, key: str = "id", vec: str = "vec") -> DataFrame:
    """V8: 2-D / 3-D coordinates ``(key, x, y[, z])``."""
    model = fit_reducer(df, dims, vec)
    r = reduce(df, model, vec, "xy")
    names = ["x", "y", "z"][:dims]
    return r.select(key, *[F.col("xy")[i].alias(n) for i, n in enumerate(names)])


def reduce_and_cluster(df: DataFrame, k: int, eps: float, min_samples: int, min_cluster_size: int,
                       key: str = "id", vec: str = "vec") -> DataFrame:
    """Reduce (V6 + V7) then density-cluster (C1): ``(key, cluster)``."""
    from tessera.operators.cluster import density_cluster

    model = fit_reducer(df, k, vec)
    red = reduce(df, model, vec, "r").select(key, F.col("r").alias(vec))
    return density_cluster(red, eps, min_samples, min_cluster_size, key, vec)


def reduce_cluster_report(df: DataFrame, k: int, eps: float, min_samples: int, min_cluster_size: int,
                          key: str = "id", vec: str = "vec", dims: int = 2) -> DataFrame:
    """C3 with its report: ``(key, cluster, x, y[, z], silhouette)``.  One fit serves both reducers, because
    the first ``dims`` principal components of ``k`` are those of a reduction to ``dims``.  The mean cosine
    silhouette of the clustering on the reduced vectors (-1 is one more cluster) stands in every row.  A row
    without a vector has no cluster and no coordinates."""
    from tessera.operators.cluster import density_cluster
    from tessera.operators.metrics import silhouette_linear

    red = hold(reduce(df, fit_reducer(df, k, vec), vec, "r").select(key, F.col("r").alias(vec)), "reduced")
    some = red.filter(F.col(vec).isNotNull())
    labels = hold(density_cluster(some, eps, min_samples, min_cluster_size, key, vec).select(key, "cluster"), "clusters")
    quality = silhouette_linear(some.join(labels, key), key, vec, "cluster", "cosine")
    at = [F.col(vec)[i].alias(n) for i, n in enumerate(["x", "y", "z"][:dims])]
    return red.select(key, *at).join(labels, key, "left").withColumn("silhouette", quality.select("silhouette").scalar())


def apply_and_cluster(df: DataFrame, model_path: str, eps: float, min_samples: int, min_cluster_size: int,
                      key: str = "id", vec: str = "vec") -> DataFrame:
    """C4: load a saved reducer (``PCAModel``), reduce, then density-cluster."""
    from pyspark.ml.feature import PCAModel

    from tessera.operators.cluster import density_cluster

    red = reduce(df, PCAModel.load(model_path), vec, "r").select(key, F.col("r").alias(vec))
    return density_cluster(red, eps, min_samples, min_cluster_size, key, vec)
