"""Registered queries (``queries()``) and their SQL twins (``oracle_sql()``)."""

from tessera.plans.registry import ORACLE, QUERIES, register  # noqa: F401
from tessera.plans import topic_queries, text_queries, report_queries, vector_queries, flow_queries, summary_queries, table_queries, plugin_queries  # noqa: F401  (registers)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: sql() if callable(sql) else sql for name, sql in ORACLE.items()}
