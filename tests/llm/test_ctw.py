"""Operator 7 against a plain recursive context tree and plain word counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from conftest import SF_SMALL
from tessera.llm import ctw as M


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def grams(text):
    """(bytes before, byte) of every byte of a document's stream, with how often it occurs."""
    s = b" " * M.DEPTH + "".join(t if t == "\n" else t + " " for t in tokens(text)).encode()
    return Counter(s[i - M.DEPTH:i + 1] for i in range(M.DEPTH, len(s)))


class Tree:
    """Context-tree weighting by its definition, over training texts."""

    def __init__(self, texts):
        self.count = Counter()
        self.memo, self.known = {}, {}
        for g, n in sum(map(grams, texts), Counter()).items():
            for past, node, bit in self.events(g):
                for d in range(M.DEPTH + 1):
                    self.count[past[M.DEPTH - d:], node, bit] += n
        self.children = {}
        for ctx, node, _ in self.count:
            if ctx:
                self.children.setdefault((ctx[1:], node), set()).add(ctx)

    @staticmethod
    def events(gram):
        for b in range(8):
            yield gram[:-1], (256 | gram[-1]) >> (8 - b), (gram[-1] >> (7 - b)) & 1

    def pe(self, ctx, node):
        a, b = self.count[ctx, node, 0], self.count[ctx, node, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def pw(self, ctx, node):
        if (ctx, node) not in self.memo:
            pe = self.pe(ctx, node)
            if len(ctx) < M.DEPTH:
                below = sum(self.pw(c, node) for c in self.children[ctx, node])
                pe = np.logaddexp(pe, below) - math.log(2)
            self.memo[ctx, node] = pe
        return self.memo[ctx, node]

    def predict(self, past, node, bit, d=0):
        ctx = past[M.DEPTH - d:]
        n = [self.count[ctx, node, 0], self.count[ctx, node, 1]]
        here = (n[bit] + .5) / (sum(n) + 1)
        if d == M.DEPTH:
            return here
        deeper = past[M.DEPTH - d - 1:]
        if not self.count[deeper, node, 0] + self.count[deeper, node, 1]:
            below = here
        else:
            below = self.predict(past, node, bit, d + 1)
        stop = math.exp(self.pe(ctx, node) - math.log(2) - self.pw(ctx, node))
        return stop * here + (1 - stop) * below

    def log10(self, text):
        total = 0.0
        for g, n in grams(text).items():
            if g not in self.known:
                self.known[g] = sum(math.log10(self.predict(*e)) for e in self.events(g))
            total += n * self.known[g]
        return total


def test_query_equals_plain_version(sp):
    rows = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    train = Counter(t for d, text in rows if not held[d] for t in tokens(text))
    total, distinct = sum(train.values()), len(train)
    tree = Tree(text for d, text in rows if not held[d])
    got = {r.doc_id: r for r in M.query(sp, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        t = tokens(text)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(train[x] > 0 for x in t), total)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in t), rel_tol=1e-9)
        assert math.isclose(r.score, tree.log10(text), rel_tol=1e-6)


def test_small_corpus_exactly(sp):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the hat that the cat had", "Ünï ünï chat", "zzz the end"])]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tree = Tree(text for d, text in rows if not held[d])
    for r in M.language_model(sp.createDataFrame(rows, "doc_id long, text string"), slots=24).collect():
        assert math.isclose(r.score, tree.log10(rows[r.doc_id][1]), rel_tol=1e-6)


def test_no_node_is_lost(sp):
    """Most nodes outside the broadcast table: the join with the stored levels gives the same scores."""
    docs = sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    tree = Tree(text for d, text in rows if zlib.crc32(str(d).encode()) % 7 != 2)
    got = {r.doc_id: r.score for r in M.language_model(docs, slots=12).collect()}
    for d, text in rows:
        assert math.isclose(got[d], tree.log10(text), rel_tol=1e-6)


def test_word_order_counts(sp):
    docs = sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    text = max((r.text for r in docs.limit(50).collect() if r.text), key=len)
    more = [(10 ** 9 + i, t) for i, t in enumerate([text, " ".join(reversed(text.split())), text + "\n  "])]
    got = {r.doc_id - 10 ** 9: r.score for r in M.language_model(docs.union(sp.createDataFrame(more, docs.schema))).collect()}
    assert abs(got[0] - got[1]) > 1 and math.isclose(got[0], got[2])


def test_very_long_text_in_segments(sp):
    """A text of 5 MB: several segments, none of whose bytes or contexts is lost at a seam."""
    rows = [(1, "the cat sat"), (3, "the  quick\tbrown fox " * 240_000), (4, None), (5, "sat the")]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    tree = Tree(text for d, text in rows if not held[d])
    for r in M.language_model(sp.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        assert math.isclose(r.score, tree.log10(dict(rows)[r.doc_id]), rel_tol=1e-6)


def test_scores_do_not_depend_on_what_the_table_holds(sp):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "the hat that the cat had", "Ünï ünï chat", "zzz the end", None] * 3)]
    rows += [(2, "zebra the quick cat"), (2, "zebra the quick cat")]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, M.language_model(df).collect()), key=str)
    for slots in (0, 5, 8):
        part = sorted(map(tuple, M.language_model(df, slots=slots).collect()), key=str)
        assert len(part) == len(whole)
        for a, b in zip(whole, part):
            assert a[:5] == b[:5] and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_all_next_bytes_sum_to_one(sp):
    docs = sp.createDataFrame([(1, "abc abd abc xyz"), (2, "abc é")], "doc_id long, text string")
    d = docs.selectExpr("*", "true as train")
    counts = M.count_corpus(d)
    tree = M.publish(M.grow_tree(counts.where("kind = 1").select("key", "n")))
    for past in (b"    ", b"   a", b"  ab", b"zzzz"):
        gram = (int.from_bytes(past, "big") << 8) | np.arange(256)
        assert abs((10 ** tree.log10(gram)).sum() - 1) < 1e-5


def test_tail_join_and_repeated_rows(sp):
    rows = [(1, "a a b"), (1, "a a b"), (3, "a c"), (4, "a zz")]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, M.language_model(df).collect()))
    tail = sorted(map(tuple, M.language_model(df, head=0).collect()))
    assert len(tail) == 4 and tail[0] == tail[1]
    for a, b in zip(whole, tail):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5]) and math.isclose(a[6], b[6])


def test_odd_rows(odd, none):
    got = M.language_model(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_tokens == by[1].n_tokens == by[2].n_tokens == 1 and by[0].score == by[1].score
    assert not by[None].held_out and all(r.score < 0 for r in got)
    assert M.language_model(none).collect() == []
