"""Golden rows for the text rules, expected values derived by hand from the
ordered rule lists (SURVEY 2.15)."""

import pytest
from pyspark.sql import functions as F

from conftest import one_col
from tessera.functions import text as TX

LIGHT = [
    ("Alter (42) Mann", "Alter Mann"),
    ("Ein 12:7-Erfolg zum Start", "Ein Erfolg zum Start"),
    ("Pause (14:6) danach", "Pause danach"),
    ("Pause (6:14) danach", "Pause 614 danach"),
    ("Mehr bei BILD.de heute", "Mehr bei heute"),
    ("Am 12.03.2021 passierte es!", "Am passierte es."),
    ("Zeile eins\nZeile zwei", "Zeile einsZeile zwei"),
    ("Nord/Ost", "Nord Ost"),
    ("Preis 5 €", "Preis 5 EURO"),
    ("Hallo , ", "Hallo"),
    ("Er sagte „Ja“", "Er sagte Ja"),
    ("a\u00a0b Wort\u00adteil", "ab Wortteil"),
    ("", ""),
    ("Wort1    Wort2", "Wort1 Wort2"),
    ("Text ... mehr", "Text. mehr"),
    ("Text - mehr", "Text mehr"),
    ("Siehe http://x.de/a b", "Siehe b"),
    ("BILDplus Artikel", "Artikel"),
    ("derStandard.at berichtet", "derStandard berichtet"),
    ("50€ Rabatt", "Rabatt"),
    ("[Info] <b>fett</b>", "Info bfett b"),
]

HARD = [
    ("Hallo, Welt! 2020 war gut.", "hallo welt war gut"),
    ("ab1c", "ab"),
    ("Wort – Wort", "wort wort"),
    ("  Bild.de  bildplus x ", "bildde  x"),
]

TITLES = [
    ("Titel - Politik - Bild.de", False, "Titel Politik"),
    ("Titel - Politik - Bild.de", True, "Titel"),
    ("Ohne Strich", True, "Ohne Strich"),
    ("Eins-Zwei", True, ""),
    ("*** BILDplus Inhalt *** Mein Titel - Sport - Bild.de", True, "Mein Titel"),
]


def _run(spark, values, fn):
    df = one_col(spark, [v for v, *_ in values]).select(F.col("t"), fn(F.col("t")).alias("o"))
    return {r.t: r.o for r in df.collect()}


def test_light_cleaning(spark):
    got = _run(spark, LIGHT, TX.clean_article)
    for src, want in LIGHT:
        assert got[src] == want, (src, got[src], want)


def test_light_cleaning_lower(spark):
    df = one_col(spark, ["Der GROSSE Hund!"]).select(TX.clean_article("t", lower=True).alias("o"))
    assert df.first().o == "der grosse hund."


def test_hard_cleaning(spark):
    got = _run(spark, HARD, TX.clean_hard)
    for src, want in HARD:
        assert got[src] == want, (src, got[src], want)


@pytest.mark.parametrize("src,section,want", TITLES)
def test_strip_title(spark, src, section, want):
    df = one_col(spark, [src]).select(TX.strip_title("t", section).alias("o"))
    assert df.first().o == want


def test_sentences(spark):
    df = one_col(spark, ["Satz eins. Satz zwei.. Drei", ". ."]).select("t", TX.sentences("t").alias("s"))
    got = {r.t: r.s for r in df.collect()}
    assert got["Satz eins. Satz zwei.. Drei"] == ["Satz eins", "Satz zwei", "Drei"]
    assert got[". ."] == [""]


def test_tokens(spark):
    stop = set(TX.stopwords())
    text = "Der Hund, 42 und cannot http://x.de gehen"
    expected = [t for t in ["Der", "Hund", "und", "can", "not", "gehen"] if t not in stop]
    df = one_col(spark, [text]).select(TX.tokens("t").alias("k"))
    assert df.first().k == expected
    assert "und" in stop and "Der" not in stop


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r.g for r in df.select(TX.ngrams(F.col("t"), 2).alias("g")).collect()]
    assert got == [["a b", "b c"], [], []]
    got = df.select(TX.ngrams_upto(F.col("t"), 2).alias("g")).first().g
    assert got == ["a", "b", "c", "a b", "b c"]


def test_mix(spark):
    df = spark.createDataFrame([("Kopf", "eins zwei drei", "Titel - Sport - Bild.de")], "h string, x string, s string")
    r = df.select(TX.mix("h", "x", n_words=2).alias("a"),
                  TX.mix("h", seo_title="s", lower_strip=True).alias("b")).first()
    assert r.a == "Kopf eins zwei"
    assert r.b == "kopf Titel Sport"


def test_site_phrases_are_parameters(spark):
    df = spark.createDataFrame([("Heute Morgenpost.de meldet Regen", "Regen - Wetter - MORGENPOST")], "t string, s string")
    own = TX.light_steps(phrases=["morgenpost.de"], phrases_after=[])
    row = df.select(TX.clean_article("t", steps=own).alias("a"), TX.clean_article("t").alias("b"),
                    TX.strip_title("s", markers=[" - MORGENPOST"]).alias("c")).first()
    assert (row.a, row.b, row.c) == ("Heute meldet Regen", "Heute Morgenpost.de meldet Regen", "Regen")


def test_default_steps_hold_the_fixed_phrases():
    assert TX.light_steps() == TX.LIGHT_STEPS and len(TX.light_steps([], [])) == len(TX.LIGHT_STEPS) - 4
