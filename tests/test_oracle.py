"""Every registered query against its DuckDB twin on the smallest tables,
and the partition count never changes a result."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.check_oracle import TABLES, canon

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    c1, r1 = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[name])
    c2, r2 = canon([d[0] for d in res.description], res.fetchall())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["topic_label", "topic_desc", "topic_size"]


@pytest.mark.parametrize("name", ["topic_report", "dedup_key", "density_cluster"])
def test_partition_count_invariance(spark, name):
    q = entry.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
