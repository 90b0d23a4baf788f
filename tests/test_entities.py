import json

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import tfidf

DOC = json.dumps([{"entities": [
    {"name": "Berlin", "type": "LOCATION", "salience": 0.5, "text": {"content": "Berlin-Mitte"}},
    {"name": "Merkel", "type": "PERSON", "salience": 0.4, "text": "Merkel"},
    {"name": "X", "salience": 0.3, "mentions": [{"text": {"content": "Scholz"}, "type": "PERSON"},
                                                {"text": {"content": "Olaf"}, "type": "COMMON"}]},
    {"name": "Solo", "salience": 0.2},
    {"name": "BILD Zeitung", "type": "ORGANIZATION", "salience": 0.1},
    {"name": "Merkel", "type": "PERSON", "salience": 0.4, "text": "Merkel"},
]}])


def _table(spark):
    return spark.createDataFrame([(1, DOC, "[]", None)], "article_uid long, text string, seo_title string, kicker_headline string")


def test_parse_any_form(spark):
    rows = E.parse_entities(_table(spark)).filter(F.col("field") == "text").collect()
    got = sorted((r.text, r.type, r.salience) for r in rows)
    assert got == sorted([("Berlin-Mitte", "LOCATION", 0.5), ("Merkel", "PERSON", 0.4),
                          ("Scholz", "PERSON", 0.3), ("Olaf", "COMMON", 0.3),
                          ("Solo", None, 0.2), ("BILD Zeitung", "ORGANIZATION", 0.1)])


def test_parse_name_form_drops_brand(spark):
    rows = E.parse_entities(_table(spark), form="name").collect()
    assert sorted(r.text for r in rows) == ["Berlin", "Merkel", "Solo", "X"]


def test_filter_entities(spark):
    kept = E.filter_entities(E.parse_entities(_table(spark))).collect()
    assert sorted(r.text for r in kept) == ["Berlin-Mitte", "Merkel", "Olaf", "Scholz"]
    exact = E.filter_entities(E.parse_entities(_table(spark)).withColumn("type", E.default_type(F.col("type"))),
                              dropped_types=["NUMBER", "COMMON"]).collect()
    assert sorted(r.text for r in exact) == ["Berlin-Mitte", "Merkel", "Scholz"]


def test_weights_and_normalized_terms(spark):
    df = spark.createDataFrame([("text", "U.S.A"), ("seo_title", "Bonn"), ("kicker_headline", "Rom")], "field string, text string")
    w = E.weight_entities(df).select(E.normalize_term(F.col("text")).alias("t"), "weight").collect()
    assert sorted((r.t, r.weight) for r in w) == [("bonn", 3), ("rom", 6), ("usa", 1)]


def test_dedupe_keep_last(spark):
    df = spark.createDataFrame([(["a", "b", "a"],)], "l array<string>")
    assert df.select(E.dedupe_keep_last(F.col("l")).alias("d")).first().d == ["b", "a"]


def test_ctfidf_worked_example(spark):
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "a", 1), (1, "c", 3)], "topic_label int, term string, n long")
    rows = {(r.topic_label, r.term): r.score for r in tfidf.ctfidf(counts, 4).collect()}
    import math
    sa, sb = 2 * math.log(4 / 3), 1 * math.log(4)
    assert abs(rows[(0, "a")] - sa / (sa + sb)) < 1e-12
    assert abs(rows[(0, "b")] - sb / (sa + sb)) < 1e-12
    assert abs(rows[(1, "a")] - 0.25) < 1e-12 and abs(rows[(1, "c")] - 0.75) < 1e-12
    top = tfidf.join_ranked(tfidf.top_terms(tfidf.ctfidf(counts, 4), 2)).collect()
    assert {r.topic_label: r.words for r in top} == {0: "b, a", 1: "c, a"}
    asc = tfidf.join_ranked(tfidf.top_terms(tfidf.ctfidf(counts, 4), 2), order="asc").collect()
    assert {r.topic_label: r.words for r in asc} == {0: "a, b", 1: "a, c"}


def test_all_entities_of_a_long_field_are_kept(spark):
    from tessera.sources import fixtures as FX

    words = " ".join(f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}xx" for i in range(50))
    df = spark.createDataFrame([(1, words)], "article_uid long, text string").select(
        "article_uid", FX._entity_json(F.col("text")).alias("text"))
    assert len(E.parse_entities(df, fields=["text"]).collect()) == 50
