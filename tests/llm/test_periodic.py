"""Operator 13 against brute force over all lags, word by word."""

import hashlib
import random
import zlib

import numpy as np

from conftest import SF_SMALL
from tessera.llm import periodic as P


def brute(words, least=12):
    """All runs by definition: every lag, every maximal stretch, kept if no smaller lag has the same one."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def ids(words):
    return np.array([zlib.crc32(w.encode()) for w in words], np.uint64)


def random_words(g):
    """Repetitive sequences of many shapes over few words."""
    few = g.choice([1, 2, 3, 50])
    out = [f"w{g.randrange(few)}" for _ in range(g.randrange(60))]
    for _ in range(g.randrange(4)):
        root = [f"w{g.randrange(few)}" for _ in range(g.randrange(1, 40))]
        out += (root * g.randrange(2, 7))[:g.randrange(1, 200)] + [f"x{g.randrange(3)}"] * g.randrange(2)
    if g.random() < 0.3:
        out = out + out[:g.randrange(len(out) + 1)]
    if g.random() < 0.2:  # two stretches of one word pair, out of step
        out += ["a", "b"] * g.randrange(5, 30) + ["a"] * g.randrange(2) + ["a", "b"] * g.randrange(5, 30)
    return out


def test_equals_brute_force():
    g = random.Random(13)
    texts = [random_words(g) for _ in range(1500)]
    word = np.concatenate([ids(t) for t in texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = P.runs_of(word, doc, len(texts))
    want = [(d, *r) for d, t in enumerate(texts) for r in brute(t)]
    assert got.tolist() == [list(r) for r in want] and len(want) > 2000
    assert max(r[3] for r in want) > 64


def test_query_equals_brute_force(sp):
    got = {r.doc_id: r for r in P.query(sp, SF_SMALL).collect()}
    rows = sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    with_runs = 0
    for d, text in rows:
        words = text.encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words = [w.decode() for w in words]
        runs, r = brute(words), got[d]
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert with_runs > 10


def test_very_long_texts(sp):
    n = 700_000
    g = random.Random(1)
    root = [f"r{g.randrange(10 ** 6)}" for _ in range(100_000)]
    pairs = ["a", "b"] * 40_000
    texts = ["word " * n, " ".join(root * 3), " ".join(pairs + ["a"] + pairs)]
    got = P.periodic_runs(sp.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got[0].runs] == [(0, n, 1)] and got[0].collapsed == "word"
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 100_000)] and got[1].collapsed == " ".join(root)
    # odd periods centred on the place where the pairs lose step, besides the two stretches
    whole = [tuple(r) for r in got[2].runs]
    assert (0, 80_001, 2) in whole and (80_001, 80_000, 2) in whole
    assert len(whole) > 30_000 and all(x[1] >= 2 * x[2] for x in whole)


def test_odd_rows(sp, odd, none):
    got = P.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].runs == [] and by[0].n_words == 0 and by[2].collapsed == "" and by[None].collapsed == "no id here"
    assert [tuple(r) for r in by[20].runs] == [(0, 3000, 1)]
    rows = P.digests(P.periodic_runs(P.planted(odd))).collect()
    assert all(r.runs_sha256 and r.collapsed_sha256 for r in rows) and len(rows) == len(got)
    empty = next(r for r in rows if r.doc_id == 0)
    assert (empty.n_runs, empty.start, empty.length, empty.period, empty.exponent_milli) == (0, None, None, None, None)
    assert P.periodic_runs(none).collect() == []
