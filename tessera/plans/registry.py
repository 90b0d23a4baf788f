"""Registry of named queries and their DuckDB SQL twins.

A query is a callable ``(spark, base_dir) -> DataFrame`` that reads the shared
tables (or views Spark derives from them).  ``oracle`` holds the equivalent
SQL for the queries that have one; the others are checked by row counts and by
the property tests under ``tests/``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ensure_conf

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    """``sql`` may be a callable: it is rendered only when the twins are asked for."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, base: str) -> DataFrame:
            ensure_conf(spark)
            return fn(spark, base)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco
