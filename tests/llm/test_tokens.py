"""Operators 6 and 9 and the unit encoder: exact ids, round trips, packing rules."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF_SMALL
from tessera.llm import packing as P
from tessera.llm import tokenbin as T
from tessera.llm import tokenids

SETS = {"byte": tokenids.byte_bpe(), "word": tokenids.word_bpe()}
PIECES = [" ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "Ünï", "'s", "don't", "1", "23", " ", "　", "\x1c", "\x85", "_", "!!", "ß", "Σ",
          "é", "́", "漢", "😀", "<|endoftext|>", "-", "\x00", "​", "\x0b", "\x0c", "≠", "K", "×", "÷", "…", "'RE", "x"]


def library(kind, texts):
    t = Tokenizer.from_file(SETS[kind][0])
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module", params=sorted(SETS))
def kind(request):
    return request.param


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=25).map("".join)), min_size=1, max_size=6))
def test_units_give_the_ids_of_whole_texts(kind, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    got = [ids[a:b].tolist() for _, ids, o in tokenids.encoder(*SETS[kind]).encode(pa.array(texts), 64) for a, b in zip(o, o[1:])]
    assert got == library(kind, texts)


def test_bounded_memory_of_units():
    small = tokenids.UnitEncoder(*SETS["byte"], max_units=3)
    texts = ["one two three four five six", "seven eight one two"]
    got = [ids[a:b].tolist() for _, ids, o in small.encode(pa.array(texts), 8) for a, b in zip(o, o[1:])]
    assert got == library("byte", texts) and len(small.key) <= 3


def documents(sp):
    return sorted((r.doc_id, r.text) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())


def test_token_files_round_trip(sp):
    rows = documents(sp)
    ids = [np.array(x + [1], "<u4") for x in library("word", [t for _, t in rows])]
    start = np.cumsum([0] + [len(x) for x in ids])
    want = [(d, int(s), len(x), zlib.crc32(x)) for (d, _), s, x in zip(rows, start, ids)]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.query(sp, SF_SMALL).collect()) == want


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2 ** 32 - 1)), max_size=60))
def test_variable_length_coding(values):
    control, data = T.encode_values(np.array(values, np.uint32))
    assert T.decode_values(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4) and len(data) == sum(1 + (v > 255) + (v > 65535) + (v > 2 ** 24 - 1) for v in values)


def test_token_file_odd_rows(sp, odd, none, tmp_path):
    T.write_token_files(odd, f"file://{tmp_path}/a", SETS["word"])
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens) for r in T.read_token_files(sp, f"file://{tmp_path}/a").collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    assert len(got) == odd.count() and [r[2] for r in got] == np.cumsum([0] + [r[3] for r in got])[:-1].tolist()
    assert [r[3] for r in got if r[1] in (0, 1, 2)] == [1, 1, 1, 1]
    T.write_token_files(none, f"file://{tmp_path}/b", SETS["word"])
    assert T.read_token_files(sp, f"file://{tmp_path}/b").collect() == []


def check_packed(rows, ids):
    by = {}
    for r in rows:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start:r.start + r.length])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= P.WINDOW
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_packing_query(sp):
    rows = documents(sp)
    ids = {d: np.array(x + [0], "<u4") for (d, _), x in zip(rows, library("byte", [t for _, t in rows]))}
    got = P.query(sp, SF_SMALL).collect()
    n = check_packed(got, ids)
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for d, x in ids.items():
        parts = sorted(covered[d])
        assert [a for a, _ in parts] == np.cumsum([0] + [b for _, b in parts])[:-1].tolist() and sum(b for _, b in parts) == len(x)
    total = sum(map(len, ids.values()))
    assert total / (n * P.WINDOW) > 0.97


def test_packing_odd_rows(sp, odd, none):
    got = P.pack(odd, SETS["byte"]).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}
    assert sum(r.length for r in got if r.doc_id == 0) == 2  # the repeated null text: one end id each
    assert P.pack(none, SETS["byte"]).collect() == []


def test_plans_hold_every_piece_and_waste_little():
    g = np.random.default_rng(0)
    for n in (0, 1, 7, 400, 50_000):
        h = np.bincount(np.minimum(512, g.gamma(1.2, 200, n).astype(int)), minlength=1024)
        h[0] = 0
        plan = P.pack_lengths(h)
        got = np.zeros_like(h)
        for lengths, times in plan:
            assert sum(lengths) <= 1024
            np.add.at(got, lengths, times)
        assert (got == h).all()
        material = (np.arange(1024) * h).sum() / 1024
        assert sum(t for _, t in plan) <= material * (1.01 if n > 10_000 else 1.05) + 1


def test_knapsack_and_linear_program_by_brute_force():
    g = random.Random(2)
    for _ in range(40):
        size = np.array(sorted(g.sample(range(1, 8), 3)))
        value = np.array([g.random() for _ in size])
        got, copies = P.best_pattern(size, value, 12)
        want = max(a * value[0] + b * value[1] + c * value[2] for a in range(13) for b in range(13) for c in range(13)
                   if a * size[0] + b * size[1] + c * size[2] <= 12)
        assert abs(got - want) < 1e-9 and abs(copies @ value - got) < 1e-9 and copies @ size <= 12
        demand = np.array([g.randrange(1, 30) for _ in size], float)
        basis, use = P.solve_patterns(size, demand, 12, gap=0)
        assert np.allclose(basis @ use, demand, atol=1e-3) and (size @ basis <= 12).all()
        dual = np.linalg.solve(basis.T, np.ones(len(size)))  # no pattern is worth more than a sequence: optimal
        assert P.best_pattern(size, dual, 12)[0] <= 1 + 1e-6 or use.sum() <= (size @ demand) / 12 + 1e-3
