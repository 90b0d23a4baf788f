"""Operator 4: the scan against a quadratic search, the query on held-out planted documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import toxicity as T


def maximal_by_definition(score):
    """Maximal scoring segments by recursion: take the best segment, go on left and right of it."""
    best, at = 0, None
    for i in range(len(score)):
        total = 0
        for j in range(i, len(score)):
            total += score[j]
            if total > best:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return maximal_by_definition(score[:i]) + [(i, j, best)] + [(a + j + 1, z + j + 1, s) for a, z, s in maximal_by_definition(score[j + 1:])]


def test_scan_equals_definition():
    g = random.Random(4)
    for _ in range(300):
        score = [g.choice([-3, -2, -1, 1, 2, 5]) + g.random() / 100 for _ in range(g.randrange(25))]
        total = np.concatenate([[0], np.cumsum(score)])
        hot = np.flatnonzero(np.array(score) > 0) if score else np.zeros(0, int)
        got = T.maximal_segments(hot, total[hot].tolist(), total[hot + 1].tolist())
        want = maximal_by_definition(score)
        assert [(a, z) for a, z, _ in got] == [(a, z) for a, z, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def planted(sp, n=1500):
    g = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(n):
        text = g.choices(words, k=g.randrange(30, 300))
        toxic = d % 8 == 0
        if toxic:
            at = g.randrange(len(text))
            text[at:at] = [g.choice(["vile1", "vile2", "vile3", "vile4"]) if k % 2 else g.choice(words) for k in range(12)]
        rows.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    return sp.createDataFrame(rows, "doc_id long, text string"), sp.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents_and_passages(sp):
    docs, labels, truth = planted(sp)
    got = T.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 200 < len(held) < 400
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        if r.predicted and truth[r.doc_id]:
            top = max(r.passages, key=lambda p: p.score)
            assert "vile" in text[r.doc_id][top.start:top.end]
    # labels of the held-out fold are never learned from
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(map(str, T.toxicity(docs, flipped).collect())) == sorted(map(str, got))


def plain_version(docs, labels, held_out_of=5):
    """The whole operator in plain Python: {doc_id: (score, evidence, passages)}."""
    fold = lambda d: zlib.crc32(str(d).encode()) % held_out_of
    tokens = {d: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[0-9_a-z\x80-\xff]+", t.encode().lower())] for d, t in docs}
    bucket = {}
    for spans in tokens.values():
        for *_, w in spans:
            if w not in bucket:
                b, o = B.text_buffer(pa.array([w]))
                bucket[w] = int(B.span_hashes(b, np.array([0]), np.array([len(w)]))[0]) >> 46
    every, clean, toxic = Counter(), Counter(), Counter()
    learn = {d: y for d, y in labels if fold(d)}
    for d, spans in tokens.items():
        for *_, w in spans:
            every[bucket[w]] += 1
            if d in learn:
                (toxic if learn[d] else clean)[bucket[w]] += 1
    n0, n1, n = sum(clean.values()), sum(toxic.values()), sum(every.values())
    prior = lambda b: min(n0, n1) * every[b] / n + 0.01
    mass = min(n0, n1) + 0.01 * T.BUCKETS

    def weight(b):
        p = prior(b)
        odds = lambda y, size: math.log((y + p) / (size + mass - y - p))
        delta = odds(toxic[b], n1) - odds(clean[b], n0)
        left = abs(delta) - 2 * math.sqrt(1 / (toxic[b] + p) + 1 / (clean[b] + p))
        return math.copysign(max(left, 0.0), delta) - 0.5

    w = {b: weight(b) for b in every}
    rest = T.BUCKETS - len(w)  # buckets without a token weigh only the drift
    total = n0 + 1e-3 * T.BUCKETS
    value = lambda x: (math.fsum((clean[b] + 1e-3) * math.exp(x * w[b]) for b in w) + rest * 1e-3 * math.exp(-0.5 * x)) / total - 1
    lo, hi = 1e-6, 1.0
    while value(hi) < 0:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    found = {d: maximal_by_definition([w[bucket[x]] for *_, x in spans]) for d, spans in tokens.items()}
    best = {d: max((s for *_, s in f), default=0.0) for d, f in found.items()}
    calm = [d for d in learn if not learn[d] and tokens[d]]
    ln_k = sum(hi * best[d] - math.log(len(tokens[d])) for d in calm) / len(calm) - 0.5772156649015329
    proof = {d: sum(max(0.0, hi * s - math.log(max(1, len(tokens[d]))) - ln_k) for *_, s in f) for d, f in found.items()}
    x = {d: round(math.log1p(proof[d]), 2) for d in learn}
    a = b = 0.0
    for _ in range(100):  # Newton steps, one document at a time
        g0 = g1 = h00 = h01 = h11 = 0.0
        for d, y in learn.items():
            p = 1 / (1 + math.exp(-(a + b * x[d])))
            g0, g1 = g0 + y - p, g1 + (y - p) * x[d]
            h00, h01, h11 = h00 + p * (1 - p), h01 + p * (1 - p) * x[d], h11 + p * (1 - p) * x[d] ** 2
        g1, h11, h00 = g1 - b, h11 + 1, h00 + 1e-9
        det = h00 * h11 - h01 * h01
        a, b = a + max(-5, min(5, (h11 * g0 - h01 * g1) / det)), b + max(-5, min(5, (h00 * g1 - h01 * g0) / det))
    spans = {d: [(tokens[d][i][0], tokens[d][j][1]) for i, j, s in f if hi * s - math.log(len(tokens[d])) - ln_k > 0] for d, f in found.items()}
    return {d: (1 / (1 + math.exp(-(a + b * math.log1p(proof[d])))), proof[d], spans[d]) for d in tokens}


def test_equals_plain_version(sp):
    docs, labels, _ = planted(sp, 240)
    docs = docs.selectExpr("doc_id", "substr(text, 1, 60 + cast(doc_id * 37 % 340 as int)) as text")
    want = plain_version([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    got = T.toxicity(docs, labels).collect()
    assert len(got) == len(want) == 240
    for r in got:
        score, proof, spans = want[r.doc_id]
        assert abs(r.score - score) < 1e-6 and abs(r.evidence - proof) < 1e-6, r.doc_id
        assert [(p.start, p.end) for p in r.passages] == spans
    assert 0 < sum(len(r.passages) > 0 for r in got) < 240


def test_query_shape(sp):
    got = T.query(sp, SF_SMALL).collect()
    assert len(got) == sp.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_odd_rows(sp, odd, none):
    labels = sp.createDataFrame([(1, 0), (7, 1), (7, 0), (3, None), (None, 1), (20, 0)], "doc_id long, toxic int")
    got = T.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in T.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(none, labels).collect() == []


def test_decay_solves_its_equation():
    g = np.random.default_rng(0)
    w = g.normal(-0.5, 1, 1000)
    n = g.integers(1, 50, 1000)
    lam = T.decay(w, n)
    assert abs(((n + 1e-3) / (n + 1e-3).sum() * np.exp(lam * w)).sum() - 1) < 1e-6
