"""Language-model scores by context-tree weighting (operator 7).

The model reads a document as its lower-cased words, each followed by a blank, then a line end.
Each byte is eight binary decisions (a node 1..255 of the byte's bit tree), and every node has
its own context tree over the ``DEPTH`` bytes before it, which run on across blanks from word to word (a
document starts from a context of blanks).  At each context the Krichevsky-Trofimov estimate of the node is
mixed with the deeper contexts by the context-tree weights, computed in closed form from the
training counts:  Pw = 1/2 Pe + 1/2 prod Pw(children),  weight of stopping = 1/2 Pe / Pw.
A context the training text never showed is not mixed in: prediction stops above it.

Work in Spark: one pass counts words and byte (DEPTH+1)-grams, combined in each partition; the
tree is summed up level by level (group by the context without its oldest byte).  No node is
lost: those of at least a threshold count (at most 2**SLOTS, by a histogram of counts) are looked
up by their exact keys in a broadcast table, and grams that it cannot decide are joined with the
stored levels by (context, node), once for each distinct gram.  The tree does not change while it
scores, so a byte's probability depends on its gram alone: a worker works each distinct gram out once.  The
base score needs exact counts of
all words: words of at least a threshold count (at most ``head`` of them) are looked up in a
broadcast array, all others by a join on (document, word) rows.

Nulls and edge cases: a null or empty text is its end token alone; a null id belongs to no fold
(-1), so it trains; repeated rows are scored each; without training text every node predicts
1/2 and the base has N = V = 0; a very long text is read in segments; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, id_remainder, long_lists, materialise, prepare, release, table

NAME = "op7_context_tree"
ORACLE_SQL = None  # tests hold it against a plain recursive context tree

DEPTH = 4  # at most 6: a gram and its level fit a long
SLOTS = 22
END = b"\n"
SEGMENT = 1 << 20  # bytes of a stream worked on at a time
LEVEL = 8 * (DEPTH + 1)  # bits of (context, node) in a node's key, below its depth


# ------------------------------------------------------------------ tokens
def _scan(batch, limit=1 << 22):
    """(first document, lower-cased bytes with an end byte after each document, starts, ends,
    documents, hashes of all tokens): words, and the end byte as a token of its own."""
    buf, offs = B.text_buffer(batch.column("text"))
    for i, j in B.slices(offs, limit):
        b = B.LOWER[buf[offs[i]:offs[j]]]
        o = offs[i:j + 1] - offs[i]
        s, e, doc = B.words(b, o)
        shift = doc  # one end byte for each earlier document
        text = np.insert(b, o[1:], END[0])
        stop = o[1:] + np.arange(j - i)
        s, e, doc = (np.concatenate(x) for x in ((s + shift, stop), (e + shift, stop + 1), (doc, np.arange(j - i))))
        order = np.argsort(s, kind="stable")
        s, e, doc = s[order], e[order], doc[order]
        yield i, j, text, s, e, doc, B.span_hashes(text, s, e)


def grams_of(text: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n_docs: int):
    """(grams, documents) of the model's bytes, in segments: a (DEPTH+1)-gram as a long (oldest byte
    highest) for each byte of each document's stream.  Tokens as ``_scan`` gives them, the end last."""
    first = B.first_of_doc(doc, n_docs)
    word = np.ones(len(start), bool)
    word[first[1:] - 1] = False
    # a stream is DEPTH blanks (the context it starts from), then each word and a blank, then the end
    extra = np.cumsum(word) - word + DEPTH * (doc + 1)
    inside = ~B.SEPARATOR[text]
    inside[start[~word]] = True
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) + np.repeat(extra, end - start)
    size = len(at) + int(word.sum()) + DEPTH * n_docs
    stream = np.full(size, 32, np.uint8)
    stream[place] = text[at]
    stop = place[(np.cumsum(end - start) - 1)[first[1:] - 1]] + 1
    begin = np.concatenate([[0], stop[:-1]])
    real = np.ones(size, bool)
    real[(begin[:, None] + np.arange(DEPTH)).ravel()] = False
    for i in range(DEPTH, size, SEGMENT):
        j = min(i + SEGMENT, size)
        gram = stream[i:j].astype(np.int64)
        for d in range(1, DEPTH + 1):
            gram |= stream[i - d:j - d].astype(np.int64) << (8 * d)
        keep = np.flatnonzero(real[i:j])
        yield gram[keep], np.searchsorted(stop, keep + i, "right")


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(key, return_inverse=True)
    return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)


def count_corpus(docs: DataFrame, most: int = 1_500_000) -> DataFrame:
    """``kind, key, n`` over rows with ``train``: 0: token hash, 1: byte gram; summed.  A task holds
    about ``most`` distinct keys before it gives them on."""
    def run(batches):
        held, rows = {0: [], 1: []}, 0

        def merge():
            for kind, parts in held.items():
                held[kind] = [_sum_by(*(np.concatenate(x) for x in zip(*parts)))] if parts else []
            return sum(len(key) for parts in held.values() for key, _ in parts)

        def give():
            for kind, parts in held.items():
                for key, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])
                held[kind] = []

        for batch in batches:
            if not batch.num_rows:
                continue
            for i, j, text, s, e, doc, h in _scan(batch):
                found = [(0, h.view(np.int64))] + [(1, gram) for gram, _ in grams_of(text, s, e, doc, j - i)]
                for kind, keys in found:
                    held[kind].append(np.unique(keys, return_counts=True))
                    rows += len(held[kind][-1][0])
            if rows > 2 * most:
                rows = merge()
                if rows > most:
                    yield from give()
                    rows = 0
        merge()
        yield from give()

    return (docs.where("train").select("text").mapInArrow(run, "kind int, key long, n long")
            .groupBy("kind", "key").agg(F.sum("n").alias("n")))


# ------------------------------------------------------------------ tree
def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series after shifting x by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.astype(float), n1.astype(float)
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1)


def _weigh(batch):
    """Adds ln Pw and the weight of stopping; ``below``: sum of the children's ln Pw (null: a leaf)."""
    n0, n1 = batch.column("n0").to_numpy(), batch.column("n1").to_numpy()
    pe = kt_block(n0, n1)
    below = batch.column("below").to_numpy(zero_copy_only=False).astype(float)
    leaf = np.isnan(below)
    pw = np.where(leaf, pe, np.logaddexp(pe, np.where(leaf, pe, below)) - np.log(2))
    stop = np.where(leaf, 1.0, np.exp(pe - np.log(2) - pw))
    return pa.RecordBatch.from_arrays([batch.column(c) for c in ("ctx", "node", "n0", "n1")] + [pa.array(pw), pa.array(stop)],
                                      ["ctx", "node", "n0", "n1", "pw", "stop"])


def grow_tree(grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Levels ``depth``..0 of the tree: ``ctx, node, n0, n1, pw, stop``.  grams: ``key, n``."""
    out = "ctx long, node int, n0 long, n1 long, pw double, stop double"
    sym = F.col("key").bitwiseAND(255).cast("int")
    bits = F.explode(F.sequence(F.lit(0), F.lit(7)))
    rows = (grams.select(F.shiftright("key", 8).alias("ctx"), sym.alias("sym"), "n", bits.alias("b"))
            .select("ctx", F.expr("shiftright(256 | sym, 8 - b)").alias("node"), F.expr("shiftright(sym, 7 - b) & 1").alias("bit"), "n"))
    level = (rows.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"),
                                             F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
             .withColumn("below", F.lit(None).cast("double")))
    levels = []
    for d in range(depth, -1, -1):
        made = materialise(level.mapInArrow(by_batch(_weigh), out), f"tree{d}")
        levels.append(made)
        level = (made.withColumn("ctx", F.col("ctx").bitwiseAND((1 << (8 * (d - 1))) - 1) if d else F.col("ctx"))
                 .groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below")))
    return levels


def least_count(rows: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` rows reach with their ``n``."""
    found = rows.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("k")).count().collect()  # at most 63 rows
    by, total, least = dict(map(tuple, found)), 0, 63
    while least >= 0 and total + by.get(least, 0) <= most:
        total += by.get(least, 0)
        least -= 1
    return 1 << (least + 1)


class TreeTable:
    """Look-up table of the tree's nodes counted at least ``threshold`` times, by exact keys.  (A
    node's count never exceeds that of the same node in a shorter context.)"""

    def __init__(self, key: np.ndarray, one: np.ndarray, stop: np.ndarray, threshold: int = 1):
        order = np.argsort(key)
        self.key, self.one, self.stop = key[order], one[order], stop[order]
        self.first = np.searchsorted(self.key, np.arange(DEPTH + 2) << LEVEL)
        self.missing = 1.0 if threshold <= 1 else np.nan  # a node that is not here was never seen, or cannot be told

    def log10(self, gram: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 probability of each gram's last byte after its context; nan if that takes nodes
        below the threshold."""
        total = np.zeros(len(gram))
        sym, past = gram & 255, gram >> 8
        for b in range(8):
            node, bit = (256 | sym) >> (8 - b), (sym >> (7 - b)) & 1
            p = np.full(len(gram), 0.5)
            mass = np.ones(len(gram))  # weight not yet stopped
            value = np.zeros(len(gram))
            alive = np.arange(len(gram))
            for d in range(depth + 1):
                lo, hi = self.first[d], self.first[d + 1]
                key = (d << LEVEL) | ((past[alive] & ((1 << (8 * d)) - 1)) << 8) | node[alive]
                at = lo + np.minimum(np.searchsorted(self.key[lo:hi], key), max(hi - lo - 1, 0))
                seen = self.key[at] == key if hi > lo else np.zeros(len(key), bool)
                gone, alive, at = alive[~seen], alive[seen], at[seen]
                value[gone] += mass[gone] * p[gone] * self.missing  # the context above predicts for what is left
                here, stop = self.one[at], self.stop[at]
                p[alive] = np.where(bit[alive] == 1, here, 1 - here)
                value[alive] += mass[alive] * stop * p[alive]
                mass[alive] *= 1 - stop
            total += np.log10(value)
        return total


def publish(levels: list[DataFrame], slots: int = SLOTS) -> TreeTable:
    """The look-up table of the nodes of most counts (at most 2**slots) of all levels (deepest first)."""
    top = len(levels) - 1
    rows = None
    for k, level in enumerate(levels):
        part = level.select(F.expr(f"({top - k}L << {LEVEL}) | (ctx << 8) | node").alias("key"), (F.col("n0") + F.col("n1")).alias("n"),
                            node_one().alias("one"), "stop")
        rows = part if rows is None else rows.unionByName(part)
    threshold = least_count(rows, 1 << slots)
    held = rows.where(F.col("n") >= threshold).select("key", "one", "stop").toArrow()
    return TreeTable(*(held[c].to_numpy() for c in ("key", "one", "stop")), threshold)


def node_one():
    """The Krichevsky-Trofimov estimate of a node's one."""
    return (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)


def gram_scores(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key, lg``: log10 probabilities as ``TreeTable.log10`` gives them, by joins with all nodes of
    the levels (deepest first).  grams: distinct ``key``."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(7)))
    t = (grams.select("key", F.shiftright("key", 8).alias("past"), F.col("key").bitwiseAND(255).cast("int").alias("sym"), bits.alias("b"))
         .select("key", "past", F.expr("shiftright(256 | sym, 8 - b)").alias("node"), F.expr("shiftright(sym, 7 - b) & 1").alias("bit"),
                 F.lit(0.5).alias("p"), F.lit(1.0).alias("mass"), F.lit(0.0).alias("value")))
    for d, level in enumerate(reversed(levels)):
        nodes = level.select(F.col("ctx").alias("c"), F.col("node").alias("m"), node_one().alias("one"), "stop")
        nodes = F.broadcast(nodes) if d < 2 else nodes  # at most 255 * 256 nodes
        t = t.join(nodes, (F.col("past").bitwiseAND((1 << (8 * d)) - 1) == F.col("c")) & (F.col("node") == F.col("m")), "left")
        t = t.withColumn("p", F.expr("case when one is null then p when bit = 1 then one else 1 - one end"))
        t = t.select("key", "past", "node", "bit", "p", F.expr("case when one is null then 0D else mass * (1 - stop) end").alias("mass"),
                     F.expr("value + mass * p * coalesce(stop, 1D)").alias("value"))
    return t.groupBy("key").agg(F.sum(F.log10("value")).alias("lg"))


class GramScores:
    """log10 probabilities of grams; a worker remembers up to ``most`` of them."""

    def __init__(self, tree: TreeTable, most: int = 1_500_000):
        self.tree, self.most = tree, most
        self.key, self.value = np.zeros(0, np.int64), np.zeros(0)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Of distinct grams, ascending; nan where the table cannot decide."""
        pos = np.searchsorted(self.key, grams)
        known = np.zeros(len(grams), bool)
        inner = pos < len(self.key)
        known[inner] = self.key[pos[inner]] == grams[inner]
        value = np.empty(len(grams))
        value[known] = self.value[pos[known]]
        new = np.flatnonzero(~known)
        for i in range(0, len(new), 100_000):
            some = new[i:i + 100_000]
            value[some] = self.tree.log10(grams[some])
        if len(new) and len(self.key) + len(new) <= self.most:
            self.key, self.value = np.insert(self.key, pos[new], grams[new]), np.insert(self.value, pos[new], value[new])
        return value


_workers: dict[int, GramScores] = {}


def _scores(tree) -> GramScores:
    """The worker's scores for this broadcast table (one is kept)."""
    key = id(tree.value)
    if key not in _workers:
        _workers.clear()
        _workers[key] = GramScores(tree.value)
    return _workers[key]


# ------------------------------------------------------------------ scores
def head_words(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes sorted, counts, threshold): the words counted at least threshold times, a power of
    two chosen so that there are at most ``head``."""
    threshold = least_count(words, head)
    top = words.where(F.col("n") >= threshold).select("h", "n").toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order], threshold


def _per_document(doc: np.ndarray, key: np.ndarray, n: np.ndarray, size: int):
    """(distinct keys of each document, their summed n, keys of each of ``size`` documents)."""
    order = np.lexsort((key, doc))
    d, v = doc[order], key[order]
    lead = np.ones(len(d), bool)
    lead[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(lead)
    return v[at], np.add.reduceat(n[order], at) if len(at) else n[:0], np.bincount(d[at], minlength=size)


def score_documents(docs: DataFrame, tree, head_h: np.ndarray, head_n: np.ndarray) -> DataFrame:
    """One row for each document: model score of the grams that the table decides, the others, the
    head's part of the base, and the tail words."""
    names = ["doc_id", "text_key", "n_tokens", "known", "logs", "score", "tail", "times", "grams", "gram_times"]
    kinds = ("doc_id long, text_key long, n_tokens long, known long, logs double, score double, "
             "tail array<long>, times array<long>, grams array<long>, gram_times array<long>")

    def kernel(batch):
        cols = [[] for _ in range(5)]
        tails, lefts = [], []
        model = _scores(tree)
        for i, j, text, s, e, doc, h in _scan(batch):
            n = j - i
            first = B.first_of_doc(doc, n)
            pos = np.minimum(np.searchsorted(head_h, h), max(len(head_h) - 1, 0))
            inside = head_h[pos] == h if len(head_h) else np.zeros(len(h), bool)
            c = np.where(inside, head_n[pos], 0) if len(head_h) else np.zeros(len(h), np.int64)
            cols[0].append(B.reduce_docs(np.add, B.mix(h * (np.arange(len(h), dtype=np.uint64) - first[doc].astype(np.uint64) + np.uint64(1))), first, np.uint64(0)).view(np.int64))
            cols[1].append(np.diff(first))
            cols[2].append(np.bincount(doc[inside], minlength=n))
            cols[3].append(np.bincount(doc, weights=np.log10(c + 1.0), minlength=n))
            tails.append(_per_document(doc[~inside], h[~inside].view(np.int64), np.ones(int((~inside).sum()), np.int64), n))
            score, open_ = np.zeros(n), [(np.zeros(0, np.int64),) * 2]
            for gram, owner in grams_of(text, s, e, doc, n):
                u, which = np.unique(gram, return_inverse=True)
                value = model.of(u)
                score += np.bincount(owner, weights=np.nan_to_num(value)[which], minlength=n)
                if np.isnan(value).any():
                    at = np.flatnonzero(np.isnan(value)[which])
                    open_.append((owner[at], gram[at]))
            cols[4].append(score)
            owner, gram = (np.concatenate(x) for x in zip(*open_))
            lefts.append(_per_document(owner, gram, np.ones(len(gram), np.int64), n))
        lists = []
        for parts in (tails, lefts):
            key, times, sizes = (np.concatenate(x) for x in zip(*parts))
            first = np.concatenate([[0], np.cumsum(sizes)])
            lists += [long_lists(key, first), long_lists(times, first)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(np.concatenate(c)) for c in cols), *lists], names)

    return docs.select("doc_id", "text").mapInArrow(by_batch(kernel), kinds)


def language_model(docs: DataFrame, held_out_of: int = 7, held_out: int = 2, head: int = 1 << 18,
                   slots: int = SLOTS) -> DataFrame:
    """Scores of every document; learns from those whose crc32(id) mod ``held_out_of`` is not ``held_out``."""
    spark = docs.sparkSession
    fold = id_remainder("doc_id", held_out_of)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold != held_out).alias("train"))
    counts = materialise(count_corpus(docs), "counts")
    words = counts.where("kind = 0").select(F.col("key").alias("h"), "n")
    levels = grow_tree(counts.where("kind = 1").select("key", "n"))
    tree = spark.sparkContext.broadcast(publish(levels, slots))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head_h, head_n, threshold = head_words(words, head)
    scored = materialise(score_documents(docs, tree, head_h, head_n), "scored")
    # rows that repeat (id, text) share their tail words: count them once and give all the sum
    tail = (scored.select("doc_id", "text_key", F.explode(F.arrays_zip("tail", "times")).alias("t"))
            .select("doc_id", "text_key", F.col("t.tail").alias("h"), F.col("t.times").alias("k")))
    sums = (tail.join(words.where(F.col("n") < threshold), "h")
            .groupBy("doc_id", "text_key").agg(F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("tail_logs"), F.sum("k").alias("tail_known")))
    left = (scored.select("doc_id", "text_key", F.explode(F.arrays_zip("grams", "gram_times")).alias("t"))
            .select("doc_id", "text_key", F.col("t.grams").alias("key"), F.col("t.gram_times").alias("k")))
    known = materialise(gram_scores(left.select("key").distinct(), levels), "grams")
    rest = left.join(known, "key").groupBy("doc_id", "text_key").agg(F.sum(F.col("k") * F.col("lg")).alias("rest_score"))
    release(*levels)
    copies = scored.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n_tokens", "known", "logs", "score")))
    both = copies.alias("a").join(sums.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key"), "left")
    both = both.join(rest.alias("r"), F.expr("a.doc_id <=> r.doc_id and a.text_key = r.text_key"), "left")
    share = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    size = float(np.log10(total + distinct + 1)) if total + distinct else 0.0
    return (both.select("a.*", "tail_logs", "tail_known", share("rest_score").alias("rest_score"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", (id_remainder("doc_id", held_out_of) == held_out).alias("held_out"), "n_tokens",
                    (F.col("known") + share("tail_known").cast("long")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                    (F.col("logs") + share("tail_logs") - F.col("n_tokens") * F.lit(size)).alias("base_score"),
                    (F.col("score") + F.col("rest_score")).alias("score")))


def query(spark, sf_dir):
    prepare(spark)
    return language_model(table(spark, sf_dir, "documents", "doc_id", "text"))
