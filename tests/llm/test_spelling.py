"""Operator 11 against brute force over all deletions of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import spelling as S


def plain_counts(rows, damage=None, least=7):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if damage and d is not None and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    return n


def plain_variants(n, factor=10):
    """{word: (form, root, n, n_near, form_n)}: near words share a deletion, then are compared."""
    shared = defaultdict(set)
    for w in n:
        shared[w].add(w)
        for k in range(len(w)):
            shared[w[:k] + w[k + 1:]].add(w)

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {w: {x for k in [w, *(w[:k] + w[k + 1:] for k in range(len(w)))] for x in shared[k] if one_edit(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def as_dict(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_crc_of_spans():
    g = random.Random(1)
    words = [bytes(g.randrange(256) for _ in range(g.choice([1, 3, 9, 64, 65, 300]))) for _ in range(200)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    before = [b"%d:" % k for k in range(200)]
    got = S.crc_on(np.array([zlib.crc32(x) for x in before], np.uint32), buf, end - [len(w) for w in words], end)
    assert got.tolist() == [zlib.crc32(x + w) for x, w in zip(before, words)]


def test_query_equals_brute_force(sp):
    rows = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    n = plain_counts(rows, 31)
    want = plain_variants({w: c for w, c in n.items() if c >= 2})
    assert as_dict(S.query(sp, SF_SMALL)) == want
    assert sum(v[0] is not None for v in want.values()) >= 5 and len(want) > 1000


def test_dense_neighbourhoods_chains_and_subtrees(sp):
    g = random.Random(3)
    n = Counter()
    for _ in range(40):
        base = "".join(g.choice("abcéÿ") for _ in range(g.choice([7, 8, 12, 31, 32, 33, 40])))
        for k in range(30):
            w = list(base)
            for _ in range(g.randrange(3)):
                at, how = g.randrange(len(w)), g.randrange(3)
                w[at:at + (how != 0)] = [] if how == 1 else [g.choice("abcdé")]
            n["".join(w)] += g.choice([2, 3, 20, 30, 400, 5000])
    n.update({"xaaaaaaa": 100000, "xaaaaaa": 10000, "xaaaaab": 1000, "xaaaacb": 100, "xaaadcb": 10, "aaaaaaaa": 7, "a" * 500: 9, "a" * 499: 90})
    want = plain_variants(n)
    words = sp.createDataFrame(list(n.items()), "word string, n long")
    for leaf in (20_000, 40):  # few and many subtrees
        near = {r.word: (r.n_near, r.best_n, r.best) for r in S.near_words(words, leaf_words=leaf, chunk=50).collect()}
        assert {w: v[0] for w, v in near.items()} == {w: v[3] for w, v in want.items() if v[3]}
        assert all(near[w][1:] == (v[4], v[0]) for w, v in want.items() if v[0])
    text = sp.createDataFrame([(1, " ".join(w for w, c in n.items() for _ in range(min(c, 60))))], "doc_id long, text string")
    assert as_dict(S.variants(text)) == plain_variants({w: min(c, 60) for w, c in n.items() if len(w) >= 7})
    chain = {r.word: r.root for r in S.roots(sp.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(18)], "word string, form string")).collect()}
    assert set(chain.values()) == {"w18"} and len(chain) == 18


def test_words_of_a_text(sp):
    texts = ["Straßenbahn STRASSENBAHN, Äpfelchen-äpfelchen ×÷×÷×÷× nächstełletter", None, "", "a" * 300_000 + " " + "a" * 300_000]
    df = sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for damage in (None, 2):
        assert dict(map(tuple, S.count_words(df, damage=damage).collect())) == dict(plain_counts(enumerate(texts), damage))


def test_very_long_text(sp):
    g = random.Random(5)
    vocabulary = ["".join(g.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]
    texts = [(1, " ".join(g.choices(vocabulary, k=350_000))), (2, "b" * 2_000_000), (3, "b" * 2_000_000)]
    got = as_dict(S.variants(sp.createDataFrame(texts, "doc_id long, text string"), damage=31))
    want = plain_variants({w: c for w, c in plain_counts(texts, 31).items() if c >= 2 and len(w) < 100})
    assert {w: v for w, v in got.items() if len(w) < 100} == want
    assert got["b" * 2_000_000][2:4] == (2, 0)


def test_odd_rows(sp, odd, none):
    got = as_dict(S.variants(odd, damage=31))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == plain_variants({w: c for w, c in plain_counts(rows, 31).items() if c >= 2})
    assert as_dict(S.variants(none)) == {}
