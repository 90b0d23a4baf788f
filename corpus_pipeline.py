"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and returns
the columns of ``documents``; the last returns the packed pieces.  ``run`` writes each stage's
rows as Parquet into the shared checkpoint folder and reads them back for the next.

Nulls and edge cases: rows without an id pass every stage but packing unchanged; a null or empty text is
no document to drop (it scores as clean, has no lines, no shingles and no overlap) and packs to
its end id alone; a text whose lines all go becomes empty and stays; rows that repeat an id are one document
up to near-dedup, where one row of each id stays (the least by all columns) and the others go; of
equal lines or texts the occurrence of the least id stays; extra columns stay to the end of the
fourth stage; an empty table gives no rows.
"""

from __future__ import annotations

from tessera.llm import decontam, linededup, neardup, packing, tokenids, toxicity
from tessera.llm.common import materialise, one_row_each, prepare, release, table, without


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches 0.5 go."""
    prepare(spark)
    found = toxicity.toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return without(docs, found.where("predicted = 1"))


def drop_repeated_lines(spark, docs, sf_dir):
    """Of each group of near-equal lines the first stays; documents keep their other lines."""
    prepare(spark)
    return linededup.drop_lines(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (five-word shingles, Jaccard 0.8), in one row."""
    prepare(spark)
    groups = neardup.near_duplicates(docs, words=5, percent=80, bands=16)
    return one_row_each(without(docs, groups.where("not kept")))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go."""
    prepare(spark)
    return without(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text")))


def pack_windows(spark, docs, sf_dir):
    """The pieces of the remaining documents in windows of 1,024 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenids.byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # trained scores, MinHash and packing have no SQL form; tests hold it against a step-by-step version


def run(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs)
        docs = after
    return docs
