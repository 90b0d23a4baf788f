"""D7/D8 against dense numpy power iteration on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import summaries as SM


def test_pagerank_matches_dense(spark):
    docs = [(0, ["a", "b", "c", "a", "d"]), (0, ["b", "c"]), (1, ["x", "y", "x", "z"])]
    toks = spark.createDataFrame(docs, "topic_label int, t array<string>")
    edges = SM.word_graph(toks)
    nodes = toks.select("topic_label", F.explode("t").alias("word")).distinct()
    got = {(r.topic_label, r.word): r.pr for r in SM.pagerank(nodes, edges, tolerance=1e-6).collect()}
    for topic in (0, 1):
        words = sorted({w for t, ws in docs if t == topic for w in ws})
        idx = {w: i for i, w in enumerate(words)}
        W = np.zeros((len(words), len(words)))
        for t, ws in docs:
            if t != topic:
                continue
            for a, b in zip(ws, ws[1:]):
                if a != b:
                    W[idx[a], idx[b]] += 1
                    W[idx[b], idx[a]] += 1
        P = W / W.sum(1, keepdims=True)
        n = len(words)
        v = np.full(n, 1 / n)
        for _ in range(500):
            v = (1 - 0.85) / n + 0.85 * (v @ P)
        for w in words:
            assert abs(got[(topic, w)] - v[idx[w]]) < 1e-5
        assert abs(sum(got[(topic, w)] for w in words) - 1.0) < 1e-6


def test_topic_abstract_matches_dense(spark):
    rng = np.random.default_rng(5)
    rows = []
    for topic in (0, 1):
        for i in range(12):
            x = rng.normal(size=8)
            x /= np.linalg.norm(x)
            rows.append((topic, f"{topic}:{i}", f"s{topic}-{i}", i, [float(v) for v in x]))
    df = spark.createDataFrame(rows, "topic_label int, sid string, sentence string, pos int, vec array<double>")
    res = SM.topic_abstract(df, order=("pos",), dim=8).collect()
    got = {r.topic_label: r.sentence for r in res}
    scores = {r.topic_label: r.score for r in res}
    for topic in (0, 1):
        X = np.array([r[4] for r in rows if r[0] == topic])
        W = (1 + X @ X.T) / 2
        P = W / W.sum(1, keepdims=True)
        v = np.full(len(X), 1 / len(X))
        for _ in range(500):
            v = v @ P
        assert got[topic] == f"s{topic}-{int(np.argmax(np.round(v, 12)))}"
        assert abs(scores[topic] - round(float(v.max()), 6)) < 1e-6


def test_central_sentence_matches_dense(spark):
    texts = {0: ["alpha beta", "beta gamma gamma", "gamma delta", "omega psi", "psi omega omega chi", "?!", "chi"],
             1: ["same words here", "same words here", "other words"], 2: ["- -"]}
    rows = [(t, k, s, k) for t, ss in texts.items() for k, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "topic_label int, sid long, sentence string, pos int")
    weights = SM.sentence_weights(df)
    got = {(r.topic_label, r.sid): r.v for r in SM.sentence_scores(weights).collect()}
    words = sorted({r.term for r in weights.select("term").distinct().collect()})
    x = {}
    for r in weights.collect():
        x.setdefault((r.topic_label, r.sid), np.zeros(len(words)))[words.index(r.term)] = r.x
    assert set(got) == set(x) and len(x) == len(rows) - 2  # two sentences have no term
    for topic in (0, 1):
        keys = sorted(k for k in x if k[0] == topic)
        X = np.array([x[k] for k in keys])
        assert np.allclose((X * X).sum(1), 1)
        W = X @ X.T
        P = W / W.sum(1, keepdims=True)
        v = np.full(len(keys), 1 / len(keys))
        for _ in range(2000):
            v = v @ P
        assert np.allclose([got[k] for k in keys], v, atol=1e-9)
    best = {r.topic_label: r.sentence for r in SM.central_sentence(df).collect()}
    assert set(best) == {0, 1}  # a topic of sentences without terms has none
    assert best[1] == "same words here" and best[0] in texts[0]
    assert SM.central_sentence(df.limit(0)).count() == 0


def test_topic_sums_of_several_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 7 == 0 else f"t{i % 3}", [float(v) for v in rng.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "topic_label string, x array<double>").repartition(3)
    got = {r.topic_label: r for r in SM.topic_sums(df, "topic_label", 4).collect()}
    assert set(got) == {"t0", "t1", "t2"}
    for topic, r in got.items():
        mine = np.array([x for t, x in rows if t == topic])
        assert r.n == len(mine) and np.allclose(r.S, mine.sum(0))
