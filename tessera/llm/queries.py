"""Registry of the training-data queries (``opN_<name>``, ``pipeline``) and their SQL twins."""

from __future__ import annotations

import importlib

import corpus_pipeline

# One module for each operator; each has NAME, query(spark, sf_dir) and ORACLE_SQL (or None).
MODULES = ["chat", "quality", "langid", "toxicity", "linededup", "tokenbin", "ctw", "decontam", "packing", "neardup",
           "spelling", "subword", "periodic"]


def _modules():
    return [importlib.import_module(f"tessera.llm.{m}") for m in MODULES]


def queries():
    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    twins = {m.NAME: m.ORACLE_SQL for m in _modules()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in twins.items() if sql}
