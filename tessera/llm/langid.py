"""Language identification by rank-order profiles (operator 3, after Cavnar and Trenkle 1994).

Letter n-grams (n = 1..3) of the lower-cased words, each word padded by one blank on either
side; everything that is not a letter is a blank.  A profile is the list of the ``top`` most
frequent n-grams.  A document's language is the profile with the least out-of-place distance
to the document's own list (an n-gram that the profile lacks costs ``top``).

n-grams are exact: three 16-bit letters and their number in one long.  Letters beyond the basic
plane share a private range of 6,400 codes.  Counts are summed per slice and partition in numpy;
only (language, n-gram, count) rows are shuffled.  The model is ``top`` rows for each language,
and more than ``max_languages`` languages are an error, so its size is bounded.

Ties: equal counts rank by the n-gram's code points, equal distances go to the first language.
Nulls and edge cases: a null text or one without letters is ``und`` with score 0; null languages
and null ids are never learned from; without any learned language all are ``und``; repeated rows
are predicted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, id_remainder, prepare, table

NAME = "op3_rank_profiles"
ORACLE_SQL = None  # tests hold it against a plain Python version and held-out labels

UND = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of each basic-plane letter, 0 for everything else."""
    out = np.zeros(1 << 16, np.uint16)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, documents): the letters of each document with single blanks (0) between its
    words and around it."""
    cps = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=at[1:])
    low = _letters()[np.minimum(cps, 0xFFFF)]
    high = np.flatnonzero(cps > 0xFFFF)
    if len(high):
        astral, inv = np.unique(cps[high], return_inverse=True)
        low[high] = np.array([0xE000 + int(c) % 6400 if chr(c).isalpha() else 0 for c in astral], np.uint16)[inv]
    first = at[offs]
    n = len(offs) - 1
    x = np.insert(low, first, 0)  # a blank before each document and one at the end
    doc = np.repeat(np.arange(n + 1), np.append(np.diff(first) + 1, 1))
    doc[-1] = max(n - 1, 0)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep], doc[keep]


def gram_counts(buf: np.ndarray, offs: np.ndarray):
    """Distinct n-grams of each document: (document, n-gram as a long, count), sorted by document
    and n-gram."""
    x, doc = letters(buf, offs)
    present = np.zeros(1 << 16, bool)
    present[x] = True
    present[0] = True
    codes = np.flatnonzero(present)
    size = np.uint64(len(codes))
    small = np.zeros(1 << 16, np.uint64)
    small[codes] = np.arange(len(codes), dtype=np.uint64)
    c = small[x]
    d = doc.astype(np.uint64) * np.uint64(3)
    one = np.flatnonzero(c)
    # a blank belongs to the word before it, so a gram's document is that of its letters
    two = np.flatnonzero((c[:-1] != 0) | (c[1:] != 0)) if len(c) > 1 else one[:0]
    tri = np.flatnonzero(c[1:-1] != 0) if len(c) > 2 else one[:0]
    d2 = np.where(c[two] != 0, d[two], d[np.minimum(two + 1, len(d) - 1)])
    cube = size * size * size
    keys = np.concatenate([
        d[one] * cube + c[one] * size * size,
        (d2 + np.uint64(1)) * cube + (c[two] * size + c[np.minimum(two + 1, len(c) - 1)]) * size,
        (d[tri + 1] + np.uint64(2)) * cube + (c[tri] * size + c[tri + 1]) * size + c[tri + 2 if len(tri) else tri]])
    keys.sort()
    lead = np.ones(len(keys), bool)
    lead[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(lead)
    count = np.diff(np.append(at, len(keys)))
    key = keys[at]
    who, rest = key // cube, key % cube
    a, rest = codes[(rest // (size * size)).astype(np.int64)], rest % (size * size)
    b, z = codes[(rest // size).astype(np.int64)], codes[(rest % size).astype(np.int64)]
    n = (who % np.uint64(3)).astype(np.int64) + 1
    return (who // np.uint64(3)).astype(np.int64), (n << 48) | (a << 32) | (b << 16) | z, count


def _merge(parts):
    """(language code, n-gram) sums of several (code, gram, count) triples."""
    code, gram, count = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, code))
    code, gram, count = code[order], gram[order], count[order]
    lead = np.ones(len(code), bool)
    lead[1:] = (code[1:] != code[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(lead)
    return code[at], gram[at], np.add.reduceat(count, at) if len(at) else count


def profiles(docs: DataFrame, top: int = 300, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """The ``top`` most frequent n-grams of each language, most frequent first."""
    def run(batches):
        names, parts, held = [], [], 0

        def flush():
            code, gram, count = _merge(parts)
            return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(code)), pa.array(gram), pa.array(count)],
                                              ["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for name in langs:
                if name not in names:
                    names.append(name)
            code_of = np.array([names.index(x) for x in langs], np.int64)
            buf, offs = B.text_buffer(batch.column("text"))
            for i, j in B.slices(offs, 1 << 20):
                if offs[j] > offs[i]:
                    d, gram, count = gram_counts(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                    parts.append(_merge([(code_of[i:j][d], gram, count)]))
                    held += len(parts[-1][0])
            if held > 1_500_000:
                parts, held = [_merge(parts)], 0
                if len(parts[0][0]) > 1_000_000:
                    yield flush()
                    parts = []
        if parts:
            yield flush()

    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    n = learn.select("lang").distinct().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn")
    total = learn.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("lang", "gram", "rank").toPandas())
    return {lang: g.sort_values("rank")["gram"].to_numpy() for lang, g in rows.sort_values("lang").groupby("lang")}


def distances(buf: np.ndarray, offs: np.ndarray, model: dict[str, np.ndarray], top: int):
    """(documents x languages) out-of-place distances, and the n-grams compared in each document."""
    known = np.unique(np.concatenate(list(model.values())))
    rank = np.full((len(model), len(known) + 1), -1, np.int64)
    for k, grams in enumerate(model.values()):
        rank[k, np.searchsorted(known, grams)] = np.arange(len(grams))
    n = len(offs) - 1
    d, gram, count = gram_counts(buf, offs)
    most = int(count.max()) + 1 if len(count) else 1
    order = np.argsort(d * most + (most - count), kind="stable")  # ties stay in n-gram order
    d, gram = d[order], gram[order]
    place = np.arange(len(d)) - B.first_of_doc(d, n)[d]
    keep = place < top
    d, gram, place = d[keep], gram[keep], place[keep]
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    at = np.where(known[at] == gram, at, len(known))
    out = np.zeros((n, len(model)))
    for k in range(len(model)):
        r = rank[k, at]
        out[:, k] = np.bincount(d, weights=np.where(r < 0, top, np.abs(r - place)), minlength=n)
    return out, np.bincount(d, minlength=n)


def predict(docs: DataFrame, model: dict[str, np.ndarray], top: int = 300) -> DataFrame:
    """``lang_pred, score`` beside ``doc_id``; score: 1 - least distance / greatest possible."""
    langs = np.array([*model, UND], object)

    def kernel(batch):
        buf, offs = B.text_buffer(batch.column("text"))
        pred, score = [], []
        for i, j in B.slices(offs, 1 << 20):
            if not model or offs[j] == offs[i]:
                pred.append(np.full(j - i, len(model)))
                score.append(np.zeros(j - i))
                continue
            far, n = distances(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], model, top)
            best = far.argmin(1)
            pred.append(np.where(n > 0, best, len(model)))
            score.append(np.where(n > 0, 1 - far[np.arange(j - i), best] / np.maximum(n * top, 1), 0.0))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs[np.concatenate(pred)], pa.string()),
                                           pa.array(np.concatenate(score))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        by_batch(kernel), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, held_out_of: int = 3, top: int = 300) -> DataFrame:
    """Predictions for every document; learns from documents whose crc32(id) mod ``held_out_of`` is not 1."""
    fold = id_remainder("doc_id", held_out_of)
    model = profiles(docs.where((fold >= 0) & (fold != 1)), top)
    out = predict(docs, model, top)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir):
    prepare(spark)
    return language_id(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
