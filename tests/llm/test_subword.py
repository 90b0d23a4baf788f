"""Operator 12: features against a plain version, training on planted classes, held-out labels."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import subword as S

SF_LARGER = "/root/testdata/sf0.01"


def plain_features(text):
    """What a document's bag holds, as readable keys."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    bag = Counter(("w", w) for w in words)
    bag.update(("p", a, b) for a, b in zip(words, words[1:]))
    bag.update(("same", lag) for lag in range(1, S.BACK + 1) for a, b in zip(words, words[lag:]) if a == b)
    for w in words:
        edged = b" " + w + b" "
        bag.update(("g", edged[k:k + n]) for n in S.GRAMS for k in range(len(edged) - n + 1))
    return bag


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    one = np.asarray(label) == 1
    return (rank[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def test_features_are_the_bag():
    g = random.Random(3)
    texts = [None, "", " \n", "x", "ab", "the the the cat, the Ünï"] + [
        "".join(g.choice("abcß€ \n\t#A1") for _ in range(g.randrange(200))) for _ in range(200)]
    got = [Counter() for _ in texts]
    limit, S.SLICE = S.SLICE, 500
    try:
        for i, j, bucket, row in S.features(pa.array(texts)):
            for b, r in zip(bucket.tolist(), row.tolist()):
                got[i + r][b] += 1
    finally:
        S.SLICE = limit
    key_of = {}
    for text, bag in zip(texts, got):
        want = plain_features(text or "")
        assert sum(bag.values()) == sum(want.values())
        assert sorted(bag.values(), reverse=True)[:3] == sorted(want.values(), reverse=True)[:3] or len(bag) < len(want)
        one, _ = B.text_buffer(pa.array([text or ""]))
        if sum(want.values()) == 1:
            key_of.setdefault(next(iter(want)), set()).update(bag)
    assert all(len(v) == 1 for v in key_of.values())


def planted(sp, n=900):
    """Label 0: glued symbols, or one word again and again (a different one in each document)."""
    g = random.Random(8)
    words = ["".join(g.choice("abcdefgh") for _ in range(g.randrange(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for d in range(n):
        text = g.choices(words, k=g.randrange(20, 150))
        if d % 6 == 0:
            text = [w + g.choice(["###", "%%%"]) for w in text]
        elif d % 6 == 1:
            text = [f"again{g.randrange(10 ** 6)}"] * len(text)
        rows.append((d, " ".join(text)))
        labels.append((d, int(d % 6 > 1)))
    return sp.createDataFrame(rows, "doc_id long, text string"), sp.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


def test_planted_classes_and_held_out_labels_unused(sp):
    docs, labels, truth = planted(sp)
    got = S.classify(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 900 and {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got} == {True}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held) and len(held) > 100
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    again = S.classify(docs.repartition(7), flipped).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in again) == sorted((r.doc_id, round(r.score, 9)) for r in got)


def test_score_is_the_softmax_of_the_average_vector(sp):
    docs, labels, _ = planted(sp, 120)
    model = S.fit(docs, labels, "quality", 1000, 10 ** 6, 2, 0.1)
    rows = {r.doc_id: np.array(r.vector) for r in S.vectors(docs, model).collect()}
    for r in S.score(docs, model).collect():
        assert abs(model.probabilities(rows[r.doc_id])[1] - r.score) < 1e-5
    small = S.fit(docs, labels, "quality", 50, 10 ** 4, 2, 0.1)  # the documented bounds hold
    assert isinstance(small, (S.Model, float))


def test_held_out_accuracy_of_the_query(sp):
    got = S.query(sp, SF_LARGER).collect()
    docs = sp.read.parquet(f"{SF_LARGER}/documents.parquet").count()
    truth = {r.doc_id: r.quality for r in sp.read.parquet(f"{SF_LARGER}/labels.parquet").collect()}
    assert len(got) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    label = [truth[r.doc_id] for r in held]
    assert auc([r.score for r in held], label) >= 0.9
    assert sum(r.predicted == y for r, y in zip(held, label)) >= 0.93 * len(held)


def test_odd_rows(sp, odd, none):
    labels = sp.createDataFrame([(1, 0), (7, 1), (7, 0), (3, None), (None, 1), (20, 0), (4, 1), (6, 1)], "doc_id long, quality int")
    got = S.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.doc_id in (0, 1, 2)}
    assert len(blank) == 1 and {r.n_features for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.score for r in S.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in S.classify(odd, labels.where("quality = 0")).collect()} == {0.0}
    assert S.classify(none, labels).collect() == []


def test_very_long_text(sp):
    docs = sp.createDataFrame([(1, "abc déf " * 700_000), (2, "abc déf ")], "doc_id long, text string")
    model = S.Model()
    model.layer[:, 1] = 1.0
    a, b = S.score(docs, model).orderBy("doc_id").collect()
    assert a.n_features > 700_000 * 14 and abs(a.score - b.score) < 0.05
