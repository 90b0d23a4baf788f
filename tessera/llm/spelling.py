"""Spelling variant grouping by a frequency-vector trie (operator 11).

Two words are near if they differ by exactly one inserted, deleted or replaced letter.  The letters
are dealt into GROUPS groups of about equal weight; a word's vector counts its letters of each
group.  One edit adds at most one to one count (a surplus) and takes at most one from one count (a
deficit).  So the words are arranged in a trie by their length and successive counts, and a search
walks down with a budget of one surplus and one deficit: at each level it follows its own count, one
more while it has a surplus to spend, one less while it has a deficit.  The words of the leaves it
reaches are verified letter by letter.  The walk is depth-first in the sense of the method but
takes all words of a block level by level, as arrays: each entry is one open path of one word.

Work in Spark: words are counted (map-side combined) and their letters' counts collected (at most 90
rows).  The trie's upper levels (length and the first ``depth`` groups) cut it into subtrees; each word is sent
to its own subtree and, with the budget left over, to those that one surplus and one deficit reach
(depth**2 + 3 depth + 3 at most).  ``depth`` is the least that leaves no more than ``leaf_words`` words in a
subtree, so a task's memory does not grow with the vocabulary; words with equal counts in all groups
(anagrams, in effect) cannot be parted.  Every word meets each subtree once, so each task returns one
row for a word (how many near words, the best of them) and no pair leaves a task.

A word's form is its near word of largest n if that is ``factor`` times its own n or more.  Chains of
forms are followed by pointer doubling: each step multiplies n by ``factor``, so six rounds are enough.

Nulls and edge cases: a null or empty text has no words; a null id damages no word (see ``count_words``);
repeated rows count again; words of any length are handled (letters of words over WIDE are
verified one pair at a time); ties of n go to the word first in code-point order; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import by_batch, materialise, prepare, release, table

NAME = "op11_spelling_variants"
ORACLE_SQL = None  # crc32 and edit distance are not both in DuckDB; tests hold it against brute force over all pairs

GROUPS = 12
WIDE = 32
SLICE = 1 << 18
_CRC = np.zeros(256, np.uint32)  # crc32's step by one byte, from the checksums of single bytes
_CRC[255 - np.arange(256)] = [zlib.crc32(bytes([k])) ^ 0xFF000000 for k in range(256)]


def crc_on(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each span, carried on from ``state`` (the crc32 of what precedes it)."""
    out = np.empty(len(start), np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int((size > 64).sum())
    for k in order[:long]:
        out[k] = zlib.crc32(buf[start[k]:end[k]].tobytes(), int(state[k]))
    order = order[long:]
    crc, at, size = ~state[order], start[order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # words of more than k bytes
        crc[:n] = _CRC[(crc[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out[order] = ~crc
    return out


def count_words(docs: DataFrame, min_letters: int = 7, damage: int | None = None) -> DataFrame:
    """``word, n``: the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of
    ``min_letters`` or more.  With ``damage``, a run loses the letter h % its length if ``damage`` divides
    h, the crc32 of ``<doc_id>:<run>``."""
    def kernel(batch):
        ids = batch.column("doc_id").to_pylist()
        buf, offs = B.text_buffer(batch.column("text"))
        words, counts = [], []
        for i, j in B.slices(offs, SLICE):
            b, o = B.LOWER[buf[offs[i]:offs[j]]], offs[i:j + 1] - offs[i]
            lead = b == 0xC3
            letter = ((b >= 97) & (b <= 122)) | lead
            letter[1:] |= lead[:-1]
            s, e = B.runs(letter, o)
            extra = np.zeros(len(b) + 1, np.int64)
            np.cumsum(lead, out=extra[1:])
            n = e - s - (extra[e] - extra[s])
            long = n >= min_letters
            s, e, n = s[long], e[long], n[long]
            whole = np.ones(len(s), bool)
            data = b.tobytes()
            if damage:
                own = np.array([zlib.crc32(b"%d:" % d) if d is not None else 0 for d in ids[i:j]], np.uint32)
                doc = B.owner(o, s)
                h = crc_on(own[doc], b, s, e)
                whole = h % np.uint32(damage) != 0
                whole |= np.array([d is None for d in ids[i:j]], bool)[doc]
                less = Counter()
                for k in np.flatnonzero(~whole & (n > min_letters)):
                    word = data[s[k]:e[k]].decode()
                    at = int(h[k]) % len(word)
                    less[word[:at] + word[at + 1:]] += 1
                words += less.keys()
                counts.append(np.fromiter(less.values(), np.int64, len(less)))
            s, e = s[whole], e[whole]
            _, first, count = np.unique(B.span_hashes(b, s, e), return_index=True, return_counts=True)
            words += [data[s[k]:e[k]].decode() for k in first]
            counts.append(count.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.concatenate(counts))], ["word", "n"])

    t = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return t.mapInArrow(by_batch(kernel), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(vocabulary: DataFrame) -> dict[int, int]:
    """Group of each letter (code point): the most frequent first, each to the lightest group so far."""
    rows = (vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
            .groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect())
    weight, out = [0] * GROUPS, {}
    for letter, n in sorted(map(tuple, rows), key=lambda r: (-r[1], r[0])):
        g = weight.index(min(weight))
        out[ord(letter)], weight[g] = g, weight[g] + n
    return out


class Letters:
    """Code points, lengths and count vectors of a list of words."""

    def __init__(self, words: list[str], group: np.ndarray):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(len(words)), self.size)
        self.vector = np.bincount(row * GROUPS + group[point], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        col = np.arange(len(point)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        fits = np.repeat(self.size <= WIDE, self.size)
        self.left = np.zeros((len(words), WIDE + 1), np.uint8)  # aligned at the first letter
        self.left[row[fits], col[fits]] = point[fits]
        self.right = np.zeros((len(words), WIDE + 1), np.uint8)  # and at the last, backwards
        self.right[row[fits], (np.repeat(self.size, self.size) - 1 - col)[fits]] = point[fits]


def near(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Mask of the word pairs that differ by exactly one edit."""
    longer = np.maximum(a.size[i], b.size[j])
    differ = a.left[i] != b.left[j]
    prefix = np.where(differ.any(1), differ.argmax(1), longer)
    differ = a.right[i] != b.right[j]
    suffix = np.where(differ.any(1), differ.argmax(1), longer)
    out = (prefix < longer) & (prefix + suffix >= longer - 1) & (np.abs(a.size[i] - b.size[j]) <= 1)
    for k in np.flatnonzero(longer > WIDE):
        x, y = sorted((a.words[i[k]], b.words[j[k]]), key=len)
        if len(y) - len(x) > 1 or x == y:
            out[k] = False
            continue
        at = next((p for p in range(len(x)) if x[p] != y[p]), len(x))
        out[k] = x[at + (len(x) == len(y)):] == y[at + 1:]
    return out


class Trie:
    """Words of one subtree by successive counts of the groups from ``depth`` on."""

    def __init__(self, letters: Letters, depth: int):
        v = letters.vector[:, depth:]
        self.order = np.lexsort(v.T[::-1]) if v.shape[1] else np.arange(len(v))
        v = v[self.order]
        self.width = int(v.max(initial=0)) + 3
        self.levels = []  # sorted keys parent * width + count + 1; a node is the place of its key
        node = np.zeros(len(v), np.int64)
        for level in range(v.shape[1]):
            key, node = np.unique(node * self.width + v[:, level] + 1, return_inverse=True)
            self.levels.append(key)
        self.leaf = np.searchsorted(node, np.arange(int(node[-1]) + 2))  # the words of each leaf

    def search(self, vector: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``vector``, word) of all words whose counts the budgets reach."""
        q, node, plus, minus = np.arange(len(vector)), np.zeros(len(vector), np.int64), surplus, deficit
        for level, keys in enumerate(self.levels):
            own = np.minimum(vector[q, level], self.width - 2)
            up, down = np.flatnonzero(plus), np.flatnonzero(minus)
            take = np.concatenate([np.arange(len(q)), up, down])
            change = np.repeat([0, 1, -1], [len(q), len(up), len(down)])
            # (a count beyond the widest word's is no child of any node)
            key = node[take] * self.width + np.minimum(own[take] + change, self.width - 2) + 1
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (vector[q[take], level] + change < self.width - 1)
            take, change, node = take[hit], change[hit], at[hit]
            q, plus, minus = q[take], plus[take] & (change != 1), minus[take] & (change != -1)
        first, last = self.leaf[node], self.leaf[node + 1]
        count = last - first
        word = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(q, count), self.order[word]


def _budgets(depth: int) -> list[tuple[int, tuple[int, ...]]]:
    """(change of length, changes of the first counts) of every subtree a word is sent to."""
    still = (0,) * depth
    one = lambda g, x: tuple(x if k == g else 0 for k in range(depth))
    out = [(0, still), (1, still), (-1, still)]
    for g in range(depth):
        out += [(0, one(g, 1)), (0, one(g, -1)), (1, one(g, 1)), (-1, one(g, -1))]
        out += [(0, tuple(x + y for x, y in zip(one(g, 1), one(k, -1)))) for k in range(depth) if k != g]
    return out


def near_words(vocabulary: DataFrame, leaf_words: int = 20_000, chunk: int = 20_000) -> DataFrame:
    """``word, n_near, best_n, best``: how many words of the vocabulary are near, and the one of largest n."""
    groups = letter_groups(vocabulary)
    group = np.zeros(256, np.int64)
    for point, g in groups.items():
        group[point] = g

    def with_vector(batch):
        x = Letters(batch.column("word").to_pylist(), group)
        head = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (GROUPS + 1)),
                                        pa.array(np.concatenate([x.size[:, None], x.vector], 1).astype(np.int32).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), head], ["word", "n", "head"])

    held = materialise(vocabulary.select("word", "n").mapInArrow(by_batch(with_vector), "word string, n long, head array<int>"), "words")
    for depth in range(1, GROUPS + 1):
        most = held.groupBy(F.slice("head", 1, depth + 1).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= leaf_words:
            break

    moves = F.array(*(F.struct(F.array(*(F.lit(x) for x in (length, *counts))).alias("move")) for length, counts in _budgets(depth)))
    sent = held.select("word", "n", F.slice("head", 1, depth + 1).alias("own"), F.explode(moves).alias("m"))
    sent = sent.select("word", "n", "m.move", F.zip_with("own", "m.move", lambda a, b: a + b).alias("key"))
    sent = sent.where(F.forall("key", lambda c: c >= 0))
    sent = sent.select(F.xxhash64("key").alias("key"), F.exists("move", lambda c: c != 0).alias("guest"), "word", "n",
                       # what the way to the subtree has left of the budget
                       (~F.exists("move", lambda c: c > 0) & (F.col("move")[0] >= 0)).alias("plus"),
                       (~F.exists("move", lambda c: c < 0) & (F.col("move")[0] <= 0)).alias("minus"),
                       F.col("move")[0].alias("longer"),
                       F.exists(F.slice("move", 2, depth), lambda c: c != 0).alias("moved"))
    # a longer word is reached by a surplus alone, a shorter one by a deficit alone
    sent = sent.withColumns({"plus": F.when(F.col("longer") == 1, ~F.col("moved")).when(F.col("longer") == -1, False).otherwise(F.col("plus")),
                             "minus": F.when(F.col("longer") == -1, ~F.col("moved")).when(F.col("longer") == 1, False).otherwise(F.col("minus"))})
    sent = sent.select("key", "guest", "word", "n", "plus", "minus").repartition("key").sortWithinPartitions("key", "guest", "word")

    def found(tree, own, n, queries, plus, minus):
        """One row for each query word with near words in the subtree."""
        x = Letters(queries, group)
        q, word = tree.search(x.vector[:, depth:], plus, minus)
        ok = np.concatenate([near(x, q[k:k + (1 << 18)], own, word[k:k + (1 << 18)]) for k in range(0, len(q), 1 << 18)]) if len(q) else np.zeros(0, bool)
        q, word = q[ok], word[ok]
        order = np.lexsort((word, -n[word], q))  # (words of a subtree are in code-point order)
        q, word = q[order], word[order]
        lead = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([queries[k] for k in q[lead]], pa.string()), pa.array(np.diff(np.append(lead, len(q))).astype(np.int64)),
            pa.array(n[word[lead]]), pa.array([own.words[k] for k in word[lead]], pa.string())], ["word", "n_near", "best_n", "best"])

    def run(batches):
        key, own, n, tree, members, guests = None, None, None, None, [], []

        def flush():
            nonlocal guests
            if guests:
                words, plus, minus = zip(*guests)
                guests = []
                return found(tree, own, n, list(words), np.array(plus), np.array(minus))

        def grow():  # all members of a subtree come before its guests; they are queries too
            nonlocal own, n, tree, members, guests
            own = Letters([m[0] for m in members], group)
            n = np.array([m[1] for m in members], np.int64)
            tree = Trie(own, depth)
            guests = [(m[0], True, True) for m in members]
            members = []

        for batch in batches:
            for k, guest, word, count, plus, minus in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    if members:
                        grow()
                    if guests:
                        yield flush()
                    key, tree = k, None
                if not guest:
                    members.append((word, count))
                    continue
                if members:
                    grow()
                if tree is not None:  # (without members there is nothing to find)
                    guests.append((word, plus, minus))
                if len(guests) >= chunk:
                    yield flush()
        if members:
            grow()
        if guests:
            yield flush()

    parts = sent.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    out = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    out = materialise(out.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")), "near")
    release(held)
    return out


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """``word, root`` for every (word, form): forms followed to the last, by pointer doubling."""
    cur = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        onward = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialise(cur.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        more = not new.where("moved").isEmpty()
        release(cur)
        cur = new.select("word", "root")
        cur._tessera_path = new._tessera_path
        if not more:
            break
    return cur


def variants(docs: DataFrame, min_letters: int = 7, min_count: int = 2, factor: int = 10, damage: int | None = None,
             leaf_words: int = 20_000) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = materialise(count_words(docs, min_letters, damage).where(F.col("n") >= min_count), "vocabulary")
    t = words.join(near_words(words, leaf_words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    t = materialise(t.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                             F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    last = roots(t.where("form is not null").select("word", "form"))
    return t.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    prepare(spark)
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"), damage=31)
