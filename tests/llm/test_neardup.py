"""Operator 10 against brute force over all pairs, and its kernels."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import neardup as N
from tessera.llm.components import components


def shingles(text, k=3):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x)
         for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(sp):
    rows = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert result(N.query(sp, SF_SMALL)) == brute(rows)


def test_chains_and_large_buckets(sp):
    """A drifting chain of copies: members link only through others; blocks force block pairs."""
    g = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows, cur = [], list(words)
    for i in range(60):
        rows.append((1000 - i, " ".join(cur)))
        cur = list(cur)
        for _ in range(2):
            cur[g.randrange(len(cur))] = f"x{i}{g.random()}"
    rows += [(2000 + i, " ".join(words)) for i in range(40)]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    assert result(N.near_duplicates(df, block=16)) == brute(rows)


def test_odd_rows(odd, none):
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[None].kept and by[None].component_id is None
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[1].component_id == 1
    assert by[21].component_id == 20 and not by[21].kept and by[20].n_shingles == 1
    assert N.near_duplicates(none).collect() == []


def test_estimate_is_close_to_exact():
    g = random.Random(1)
    a = [f"w{g.random()}" for _ in range(900)]
    for share in (0.0, 0.1, 0.3):
        b = [x if g.random() > share else f"y{g.random()}" for x in a]
        buf, offs = B.text_buffer(pa.array([" ".join(a), " ".join(b)]))
        d, v, first = N.shingle_sets(buf, offs, 3)
        sig = N.packed_minima(d, v, 2).view(np.uint64)
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert abs(N.estimate(sig[0], sig[1:2])[0] - len(x & y) / len(x | y)) < 0.06


def test_components(sp):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7001, 7000)]
    got = {r.v: r.root for r in components(sp.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {7001: 7000}
    assert got == want
