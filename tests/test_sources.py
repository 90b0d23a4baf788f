"""CSV scans (S1-S3), keyed sinks (S7-S9), lookups."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import tables as S


def test_read_articles_day_first(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as f:
        f.write("article_uid,cms_id,headline,seo_title,text,created_at,department,is_premium\n")
        f.write('a1,1,Kopf,"Titel - Sport - Bild.de","Zeile 1\nZeile 2",03/02/2021 10:11:12,sport,true\n')
        f.write("a2,2,K2,T2,x,05.06.2020,news,false\n")
    rows = {r.article_uid: r for r in S.read_articles(spark, p).collect()}
    assert rows["a1"].created_at.month == 2 and rows["a1"].created_at.day == 3
    assert rows["a1"].text == "Zeile 1\nZeile 2"
    assert rows["a2"].created_at.year == 2020 and rows["a2"].created_at.month == 6
    assert S.read_articles(spark, os.path.join(d, "missing.csv")) is None


def test_read_semicolon_drop_malformed(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "b.csv")
    with open(p, "w") as f:
        f.write("article_uid;cms_id;headline;seo_title;text;created_at;department;is_premium\n")
        f.write("a1;1;h;s;t;01/01/2021;d;true\n")
        f.write("a2;2;h;s;t;01/01/2021;d;notabool\n")
    rows = S.read_articles(spark, p, sep=";", drop_malformed=True).collect()
    assert [r.article_uid for r in rows] == ["a1"]


def test_read_entities_headerless(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    p = os.path.join(d, "e.csv")
    with open(p, "w") as f:
        f.write('0,a1,"[]","[]","[]",x,y,z\n')
    df = S.read_entities(spark, p)
    assert df.columns == ["article_uid", "kicker_headline", "text", "seo_title", "created_at_ne"]


def test_keyed_append_is_idempotent(spark):
    store = tempfile.mkdtemp(prefix="tessera-sink-") + "/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "article_uid long, v string")
    S.append(df, store)
    S.append(df, store)
    S.append(spark.createDataFrame([(3, "c")], "article_uid long, v string"), store)
    got = sorted(r.article_uid for r in spark.read.parquet(store).collect())
    assert got == [1, 2, 3]
    S.replace(spark.createDataFrame([(9, "z")], "article_uid long, v string"), store)
    assert [r.article_uid for r in spark.read.parquet(store).collect()] == [9]


def test_latest_by_ids_has_rows(spark):
    df = spark.createDataFrame([(i, f"2024-01-0{i}") for i in range(1, 6)], "article_uid long, d string") \
        .withColumn("created_at", F.to_timestamp("d"))
    assert [r.article_uid for r in S.latest(df, 2).collect()] == [5, 4]
    assert sorted(r.article_uid for r in S.by_ids(df, [1, 3]).collect()) == [1, 3]
    assert [r.article_uid for r in S.by_ids(df, 4).collect()] == [4]
    assert S.has_rows(df) and not S.has_rows(df.filter("false"))


def test_append_raises_when_the_stored_keys_cannot_be_read(spark, tmp_path):
    import pytest

    from tessera.sources import tables as TB

    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1,), (1,), (2,)], "article_uid long")
    TB.append(df, path)
    TB.append(df, path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t" / "part-broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        TB.append(df, path)
