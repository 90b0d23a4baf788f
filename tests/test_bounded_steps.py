"""Steps that must not grow faster than their input: what is shuffled, held at once, or sent on as a graph."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import ann, pairs
from tessera.operators import summaries as SM
from tessera.plans import queries


def test_bigrams_are_counted_where_their_text_is(spark, tmp_path):
    rows = [(1, "rote Katze rote Katze rote"), (1, "rote Katze"), (2, None), (3, ""), (None, "kalte Nacht kalte Nacht"), (None, "kalte Nacht")]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["bigrams"](spark, str(tmp_path))
    want = Counter()
    for i, t in rows:
        words = (t or "").split()
        want.update((i, f"{a} {b}") for a, b in zip(words, words[1:]))
    assert {(r.doc_id, r.gram): r.n for r in got.collect()} == dict(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan  # the texts of rows with an id are dealt, not their grams


def test_least_of_each_row_ties_and_missing():
    d = np.array([[4.0, 1.0, 1.0, np.nan, 9.0], [0.0, 0.0, 0.0, 0.0, 0.0], [np.inf, np.nan, 2.0, np.inf, np.inf]])
    row, col, dist = pairs._k_least(d, 2)
    assert row.tolist() == [0, 0, 1, 1, 2] and col.tolist() == [1, 2, 0, 1, 2]
    assert np.allclose(dist, [1, 1, 0, 0, 2 ** 0.5])
    g = np.random.default_rng(3)
    x = g.integers(0, 5, (300, 200)).astype(float)
    row, col, dist = pairs._k_least(x, 7)
    at = np.argsort(np.round(np.sqrt(x), 12), axis=1, kind="stable")[:, :7]
    assert (col.reshape(-1, 7) == at).all() and (row.reshape(-1, 7) == np.arange(300)[:, None]).all()


def test_knn_ships_a_vector_to_a_bounded_number_of_tiles(spark, monkeypatch):
    g = np.random.default_rng(1)
    df = spark.createDataFrame([(i, g.normal(size=3).tolist()) for i in range(400)], "id long, vec array<double>")
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 4)
    sizes = []
    real = pairs._with_blocks
    monkeypatch.setattr(pairs, "_with_blocks", lambda df, key, vec, width, rows: (sizes.append(rows), real(df, key, vec, width, rows))[1])
    assert pairs.knn(df, 2).count() == 800 and sizes == [25]  # 16 blocks, not one for each four rows


def test_search_requests_come_in_bounded_frames():
    wanted = np.array([[True, False, True], [True, True, True], [False, False, False]])
    number, blocks = np.array([5, 7, 9]), np.array([1, 2, 4])
    query, v = np.array([10, 11, 12]), np.empty(3, object)
    v[:] = [[0.0], [1.0], [2.0]]
    out = list(ann._requests(wanted, number, blocks, query, v, 3))
    assert all(len(t) <= 3 for t in out)
    got = sorted((int(r.query), int(r.cell), int(r.sub), r.v[0]) for t in out for r in t.itertuples())
    assert got == [(10, 5, 0, 0.0), *[(10, 9, k, 0.0) for k in range(4)], (11, 5, 0, 1.0), (11, 7, 0, 1.0), (11, 7, 1, 1.0),
                   *[(11, 9, k, 1.0) for k in range(4)]]


def test_word_pairs_are_counted_once_and_turned(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b", "b", "c"]), (0, ["a"]), (1, ["a", "b"]), (1, []), (1, None)], "topic_label int, t array<string>")
    g = SM.word_graph(df)
    assert sorted(tuple(r) for r in g.select("topic_label", "src", "dst", "w").collect()) == [
        (0, "a", "b", 2.0), (0, "b", "a", 2.0), (0, "b", "c", 1.0), (0, "c", "b", 1.0), (1, "a", "b", 1.0), (1, "b", "a", 1.0)]
    assert "Union" not in g._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_graph_has_a_vertex_a_term_at_most(spark, monkeypatch):
    texts = ["gamma delta", "alpha beta", "beta gamma", "omega psi", "psi chi", "rho"] * 20 + ["sigma tau", "tau rho"]
    df = spark.createDataFrame([(0, k, t, k) for k, t in enumerate(texts)], "topic_label int, sid long, sentence string, pos int")
    seen = []
    real = SM.connected_components
    monkeypatch.setattr(SM, "connected_components", lambda v, e: (seen.append((v.distinct().count(), e.count())), real(v, e))[1])
    weights = SM.sentence_weights(df)
    v = {r.sid: r.v for r in SM.sentence_scores(weights).collect()}
    assert len(v) == len(texts) and abs(sum(v.values()) - 1) < 1e-9
    part = {k: "abc" if texts[k].split()[0] in ("gamma", "alpha", "beta") else "omega" if texts[k].split()[0] in ("omega", "psi") else "rho" for k in v}
    size = Counter(part.values())
    for p, n in size.items():  # each part keeps its share of the sentences
        assert abs(sum(v[k] for k in v if part[k] == p) - n / len(texts)) < 1e-9
    terms = weights.select("term").distinct().count()
    assert seen[0][0] <= terms and seen[0][1] <= terms * 2 < len(texts)
