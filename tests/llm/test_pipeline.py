"""The pipeline equals its stages run by hand with the operators' verdicts, and handles odd input."""

import re

import corpus_pipeline as P
from conftest import SF_SMALL
from tessera.llm import decontam, linededup, neardup, toxicity
from tessera.llm.common import materialise, table


def test_stages_take_effect_and_keep_columns(sp):
    docs = table(sp, SF_SMALL, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, stage in P.STAGES[:-1]:
        out = materialise(stage(sp, docs, SF_SMALL), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.toxicity(docs, table(sp, SF_SMALL, "labels")).where("predicted = 1").collect()}
        elif name == "line_dedup":
            bad = set()
            gone = {r.doc_id: set(r.dropped) for r in linededup.dropped_lines(docs).collect()}
            before = {r.doc_id: r.text for r in docs.collect()}
            for r in out.collect():
                assert r.text == "\n".join(x for k, x in enumerate(before[r.doc_id].split("\n")) if k not in gone.get(r.doc_id, ()))
        elif name == "near_dedup":
            bad = {r.doc_id for r in neardup.near_duplicates(docs, words=5, percent=80, bands=16).where("not kept").collect()}
            texts = {}
            for r in out.collect():
                key = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)))
                assert not key or key not in texts
                texts[key] = r.doc_id
        else:
            bad = {r.doc_id for r in decontam.contaminated(docs, table(sp, SF_SMALL, "benchmark")).collect()}
            assert bad
        left = [d for d in ids(docs) if d not in bad]
        assert ids(out) == (sorted(set(left)) if name == "near_dedup" else left)
        docs = out
    packed = P.pack_windows(sp, docs, SF_SMALL).collect()
    whole = sorted(map(tuple, packed))
    assert sorted(map(tuple, P.run(sp, SF_SMALL).collect())) == whole
    assert {r.doc_id for r in packed} == set(ids(docs))


def test_one_row_of_a_repeated_id_stays(sp):
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"{k} {words[k:]} {k} " * 3, "en", "s", 7) for k in range(50)]
    rows += [(None, "no id", "en", "s", 1)] * 2
    docs = sp.createDataFrame(rows + rows + [(3, "another text", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_copies(sp, docs, SF_SMALL).collect()
    named = [r for r in got if r.doc_id is not None]
    assert len(named) == len({r.doc_id for r in named}) and len(got) - len(named) == 4
    assert all(r.text == rows[r.doc_id][1] for r in named if r.doc_id != 3)


def test_odd_rows(sp, odd, none):
    for _, stage in P.STAGES[:-1]:
        out = materialise(stage(sp, odd, SF_SMALL), "test")
        assert out.columns == odd.columns and out.where("doc_id is null").count() == 1
        assert stage(sp, none, SF_SMALL).collect() == []
    assert P.pack_windows(sp, none, SF_SMALL).collect() == []
