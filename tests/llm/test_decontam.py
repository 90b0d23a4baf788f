"""Operator 8 against a brute-force search over all items and diagonals."""

import itertools
import random
import re
import string

import numpy as np

from conftest import SF_SMALL
from tessera.llm import decontam as M


def words(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        w = "".join(c.lower() if c.isascii() else c for c in w).strip(string.punctuation.replace("_", "") + "_")
        if w:
            out.append(w)
    return out


def brute(docs, items, min_match=10, share=0.75):
    bad = set()
    for d, text in docs:
        t = words(text)
        for _, item in items:
            q = words(item)
            for diagonal in range(-len(q) + 1, len(t)):
                a, b = max(0, -diagonal), min(len(q), len(t) - diagonal)
                if b > a:
                    same = np.array([q[k] == t[k + diagonal] for k in range(a, b)])
                    if same.sum() >= min(min_match, len(q)) and M.best_run(same, share)[0] >= min(min_match, len(q)):
                        bad.add(d)
    return bad


def test_query_equals_brute_force(sp):
    docs = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = M.query(sp, SF_SMALL).collect()
    assert len(got) == len(docs)
    inside = {d for d, t in docs if any(q in t for _, q in items)}
    marked = {r.doc_id for r in got if r.contaminated}
    assert inside <= marked
    few = [d for d in docs if len(d[1]) < 1500]
    assert {d for d in marked if d in dict(few)} == brute(few, items)


def test_substitutions_are_tolerated(sp):
    g = random.Random(5)
    item = [f"q{i}" for i in range(30)]
    docs = []
    for k in range(40):
        cut = list(item)
        for at in range(g.randrange(4), 30, 6):  # every sixth word is another one
            cut[at] = f"z{g.random()}"
        around = [f"w{g.random()}" for _ in range(50)]
        docs.append((k, " ".join(around[:k]).upper() + " " + ", ".join(cut) + ". " + " ".join(around[k:])))
    docs += [(100, " ".join(item[:9])), (101, " ".join(f"w{i}" for i in range(99))), (102, " ".join(reversed(item)))]
    df = sp.createDataFrame(docs, "doc_id long, text string")
    bench = sp.createDataFrame([(7, " ".join(item)), (8, "two words"), (9, None), (None, "w1 w2 w3"), (7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in M.verdicts(df, bench).collect()}
    assert all(got[k].contaminated and got[k].item_id == 7 for k in range(40))
    assert not any(got[k].contaminated for k in (100, 101, 102))
    assert M.verdicts(sp.createDataFrame([(1, "It is TWO words!")], "doc_id long, text string"), bench).first().item_id == 8


def holds(equal, least=10):
    """The rule as the module states it, by all stretches."""
    return any(sum(equal[i:j]) >= least and 4 * sum(equal[i:j]) >= 3 * (j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1))


def test_run_is_found_wherever_it_is():
    g = random.Random(3)
    for _ in range(3000):
        equal = [g.random() < g.choice((0.6, 0.75, 0.85)) for _ in range(g.randrange(1, 40))]
        n, lo, hi = M.best_run(np.array(equal), 0.75)
        assert (n >= 10) == holds(equal) and n == sum(equal[lo:hi]) and 4 * n >= 3 * (hi - lo)


def test_masks_hit_every_run():
    masks = [(int(m[::-1], 2), len(m)) for m in M.MASKS]
    for size in range(10, 26):  # (a longer run has a part of at least 13 with the share)
        for k in range(min(size // 4, size - 10) + 1):
            for wrong in itertools.combinations(range(1, size - 1), k):
                run = (1 << size) - 1 - sum(1 << w for w in wrong)
                assert any((run >> at) & m == m for m, n in masks for at in range(size - n + 1)), bin(run)


def test_short_items_with_substitutions(sp):
    g = random.Random(8)
    items = {n: [f"q{n}x{i}" for i in range(n)] for n in (13, 15, 20, 25, 30)}
    docs, want = [], {}
    for k in range(400):
        n = g.choice(list(items))
        cut = list(items[n])
        for at in g.sample(range(n), g.randrange(1, n // 4 + 3)):
            cut[at] = f"z{g.random()}"
        want[k] = holds([a == b for a, b in zip(cut, items[n])])
        docs.append((k, " ".join(f"w{g.random()}" for _ in range(g.randrange(20))) + " " + " ".join(cut) + " end"))
    bench = sp.createDataFrame([(n, " ".join(q)) for n, q in items.items()], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in M.verdicts(sp.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want and 50 < sum(want.values()) < 350


def test_odd_rows(sp, odd, none):
    bench = sp.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    got = M.verdicts(odd, bench).collect()
    assert len(got) == odd.count()
    assert [r.contaminated for r in got if r.doc_id == 7] == [True, True]
    assert sum(r.contaminated for r in got) == 2
    assert M.verdicts(none, bench).collect() == []
    assert not any(r.contaminated for r in M.verdicts(odd, bench.where("item_id > 5")).collect())
