"""Operator 2 against a plain Python version of the base rules and of the likelihood ratio."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def grams(text):
    words = WORD.findall(text or "")
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(gram):
    buf, offs = B.text_buffer(pa.array([gram]))
    s, e, doc = B.words(buf, offs)
    h = B.span_hashes(buf, s, e)
    return int(Q.ngrams(h, doc)[0][-1])


def test_query_equals_plain_version(sp):
    docs = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    label = {r.doc_id: r.quality for r in sp.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    got = {r.doc_id: r for r in Q.query(sp, SF_SMALL).collect()}
    assert len(got) == len(docs)
    memo = {}
    raw, target = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    inside = {}
    for d, t in docs:
        inside[d] = [memo.setdefault(g, None) or memo.__setitem__(g, bucket(g)) or memo[g] for g in grams(t)]
        np.add.at(raw, inside[d], 1)
        if label.get(d) == 1:
            np.add.at(target, inside[d], 1)
    llr = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for d, t in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if inside[d]:
            assert abs(r.llr - llr[inside[d]].mean()) < 1e-9
        assert r.kept == (not r.base_failed and r.llr >= r.threshold)
    sure = [d for d in got if label.get(d) == 1 and not got[d].base_failed]
    assert sum(got[d].kept for d in sure) >= 0.95 * len(sure)


def test_odd_rows(sp, odd, none):
    labels = sp.createDataFrame([(7, 1), (7, None), (None, 1), (20, 0)], "doc_id long, quality int")
    got = Q.quality(odd, labels).collect()
    assert len(got) == odd.count()
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(((x.doc_id, x.text) for x in odd.collect()), key=lambda r: (r[0] is None, r[0]))):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
    assert all(r.base_failed for r in got if r.doc_id in (0, 1, 2, 20, 21))
    assert Q.quality(none, labels).collect() == []
    assert Q.quality(odd, labels.limit(0)).count() == odd.count()
