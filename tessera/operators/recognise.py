"""Entity recognition by a pluggable model (U2), in front of F12, F14 and F18.

A recogniser runs inside tasks on Arrow batches (``mapInArrow``), like the encoder of
``embed.embed_with``: loaded once a task, fed a fixed number of texts at a time.  Its spans come back as
one nested array a document, so entity filters, weights and descriptions follow as plain columns.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<text: string, type: string, score: double>>"
ARROW_SPANS = pa.list_(pa.struct([("text", pa.string()), ("type", pa.string()), ("score", pa.float64())]))


def recognise_with(docs: DataFrame, load_model: Callable[[], object], key: str = "doc_id", text: str = "text",
                   batch_size: int = 32) -> DataFrame:
    """``(key, entities)``: the spans that ``model.recognise(list[str])`` finds, in its order: for each text
    a list of (text, type or None, score).  A null text has no entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)  # (keys stay Arrow values: pandas would round large ones beside a null)
                found = model.recognise(part.column(text).fill_null("").to_pylist())
                rows = [[{"text": t, "type": k, "score": float(s)} for t, k, s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(rows, ARROW_SPANS)], [key, "entities"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {key_type}, entities {SPANS}")


def spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, pos, text, type, score)``: one row a span, for ``filter_score`` and ``filter_entities``."""
    return (found.select(key, F.posexplode("entities").alias("pos", "e"))
            .select(key, "pos", "e.text", "e.type", "e.score"))


def entity_json(entities: Column) -> Column:
    """Spans as the entity JSON document that ``parse_entities`` reads, the score as salience."""
    ents = F.transform(entities, lambda e: F.struct(e["text"].alias("name"), e["type"].alias("type"), e["score"].alias("salience")))
    return F.to_json(F.array(F.struct(ents.alias("entities"))))


class RuleRecogniser:
    """Spans that match a pattern; the type by length from a list in turn, the score 1 - 1 / length."""

    def __init__(self, pattern: str, types: list):
        self.pattern, self.types = re.compile(pattern), list(types)

    def recognise(self, texts: list[str]) -> list[list[tuple]]:
        return [[(w, self.types[len(w) % len(self.types)], 1 - 1 / len(w)) for w in self.pattern.findall(t)] for t in texts]
