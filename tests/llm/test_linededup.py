"""Operator 5 against brute force over all pairs of lines."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from conftest import SF_SMALL
from tessera.llm import bytescan as B
from tessera.llm import common
from tessera.llm import linededup as L

WHITE = " \t\n\x0b\x0c\r"


def occurrences(rows):
    for d, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))
            if line:
                yield d, k, line


def shingles(line, k=L.SHINGLE):
    return frozenset(line[i:i + k] for i in range(max(1, len(line) - k + 1)))


def brute(rows, percent=80):
    occ = sorted(set(occurrences(rows)))
    lines = sorted({x for _, _, x in occ})
    sets = {x: shingles(x) for x in lines}
    inverted = {}
    for x in lines:
        for s in sets[x]:
            inverted.setdefault(s, []).append(x)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {p for group in inverted.values() for p in itertools.combinations(group, 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    owner = {}
    for d, k, x in occ:
        owner.setdefault(find(x), (d, k))
    return {(d, k) for d, k, x in occ if owner[find(x)] != (d, k)}, len(pairs)


def gone(df, **options):
    return {(r.doc_id, r.number) for r in L.duplicate_lines(df, **options).collect()}


def test_query_close_to_brute_force(sp):
    rows = [tuple(r) for r in sp.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows if len(t) < 4000]
    got = gone(sp.createDataFrame(rows, "doc_id long, text string"))
    want, _ = brute(rows)
    assert len(got ^ want) <= 0.01 * len(want) and len(want) > 20
    whole = {r.doc_id: r for r in L.query(sp, SF_SMALL).collect()}
    assert len(whole) == sp.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(r.n_kept == r.n_lines - len(r.dropped) for r in whole.values())


def test_groups_chains_and_blocks(sp):
    g = random.Random(2)
    base = " ".join(f"token{g.randrange(1000)}" for _ in range(30))
    chain, rows = base, []
    for i in range(40):
        rows.append((i, f"unique line {g.random()} {g.random()}\n{chain}\n"))
        at = g.randrange(len(chain) - 4)
        chain = chain[:at] + "~" + chain[at + 1:]
    rows += [(100 + i, base.upper() + "\n  " + base) for i in range(30)]
    df = sp.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute(rows)
    assert gone(df, block=8) == gone(df, filter_bits=10) == want and len(want) > 60
    left = {r.doc_id: r.text for r in L.drop_lines(df).collect()}
    assert left[0] == rows[0][1] and left[100] == "" and left[1].startswith("unique line")


def test_one_changed_character_in_short_lines(sp):
    g = random.Random(4)
    rows = []
    for i in range(600):
        line = ""
        while len(line) < 40 + i % 51:
            line += "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randrange(2, 9))) + " "
        line = line[:40 + i % 51].strip().ljust(40, "x")
        at = g.randrange(len(line))
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "~" + line[at + 1:])]
    got = gone(sp.createDataFrame(rows, "doc_id long, text string"))
    want, _ = brute(rows)
    assert got <= want and len(want) >= 0.98 * 600 and len(got) >= 0.97 * 600


def test_lines_of_one_shingle(sp):
    rows = [(1, "----"), (2, "-----"), (3, "--------"), (4, "---"), (5, "---"), (6, "--"), (7, "\u00e4\u00e4\u00e4\u00e4"), (8, "\u00e4" * 9)]
    want, _ = brute(rows)
    assert gone(sp.createDataFrame(rows, "doc_id long, text string")) == want == {(2, 0), (3, 0), (5, 0), (8, 0)}


def test_every_shingle_of_every_line():
    g = random.Random(9)
    texts = ["".join(g.choice("ab\u00e4\u20ac\U0001f600 ") for _ in range(g.randrange(1, 14))) for _ in range(400)]
    buf, offs = B.text_buffer(pa.array(texts))
    h, line = L.line_shingles(buf, offs[:-1], offs[1:])
    of = {}
    for k, text in enumerate(texts):
        mine = h[line == k].tolist()
        assert len(mine) == max(1, len(text) - L.SHINGLE + 1)
        for at, value in enumerate(mine):
            assert of.setdefault(text[at:at + L.SHINGLE], value) == value
    assert len(set(of.values())) == len(of)


def test_very_long_texts(sp):
    g = random.Random(6)
    lines = [" ".join(f"{g.randrange(10 ** 6):x}" for _ in range(20)) for _ in range(25000)]
    rows = [(1, "\n".join(lines)), (2, lines[7] + "\n" + lines[24999] + "\nonly here"), (3, "z" * 3_000_000), (4, "z" * 3_000_000)]
    assert len(rows[0][1]) > 2_500_000
    got = gone(sp.createDataFrame(rows, "doc_id long, text string"))
    assert {(2, 0), (2, 1), (4, 0)} <= got and (2, 2) not in got and (3, 0) not in got


def test_odd_rows(sp, odd, none):
    got = L.drop_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[0] is None and by[1] == "" and by[2] == " \n\t" and by[6] == "same line\n" and by[21] == "" and by[20]
    assert by[None] == "no id here"
    assert L.drop_lines(none).collect() == []


def test_line_spans():
    buf, offs = B.text_buffer(pa.array(["a\n\n b \r\n", "", None, "\n\nx", "c"]))
    s, e, doc, number = L.lines_of(buf, offs)
    assert [bytes(buf[a:b]) for a, b in zip(s, e)] == [b"a", b"b", b"x", b"c"]
    assert doc.tolist() == [0, 0, 3, 4] and number.tolist() == [0, 2, 2, 0]


def test_line_spans_with_long_white_space():
    g = random.Random(3)
    texts = ["".join(g.choice(["a", "b ", " " * 40, "\t", "\n", "\n\n", " " * 9 + "c"]) for _ in range(g.randrange(0, 30))) for _ in range(300)]
    buf, offs = B.text_buffer(pa.array(texts))
    s, e, doc, number = L.lines_of(buf, offs)
    got = [(int(d), int(k), bytes(buf[a:b]).decode()) for a, b, d, k in zip(s, e, doc, number)]
    assert got == list(occurrences(enumerate(texts))) and any("\n" + " " * 49 + "c" in x for x in texts)


def test_texts_are_hashed_only_at_wanted_places(monkeypatch):
    """A second look at the texts hashes the lines that are asked for, not every line."""
    class Docs:
        def mapInArrow(self, run, _):
            return run

    texts = ["\n".join(f"Line {d} of {k}" for k in range(50)) for d in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts})
    table = pa.Table.from_batches(L.line_table(Docs())([batch]))
    wanted = table.column("line").to_pylist()[7::100]
    at = [(table.column("doc")[k].as_py(), table.column("number")[k].as_py()) for k in range(7, 1000, 100)]
    filled = np.zeros(1 << 15, np.uint32)
    for x in (y for slots in common._slots(L.place_of(*np.array(at).T), 20) for y in slots.tolist()):
        filled[x >> 5] |= np.uint32(1 << (x & 31))
    hashed = []
    real = B.span_hashes
    monkeypatch.setattr(B, "span_hashes", lambda buf, s, e, *a: (hashed.append(int((e - s).sum())), real(buf, s, e, *a))[1])
    found = pa.Table.from_batches(L.line_texts(Docs(), filled)([batch]))
    assert dict(zip(found.column("line").to_pylist(), found.column("text").to_pylist())) == {h: f"line {d} of {k}" for h, (d, k) in zip(wanted, at)}
    assert sum(hashed) < 0.05 * sum(map(len, texts))


def test_exact_pairs_of_sets():
    g = random.Random(12)
    texts = ["".join(g.choice("abc") for _ in range(g.randrange(1, 40))) for _ in range(80)] + ["", "abcabcabc", "abcabcabcabc"]
    i, j = (np.array(x) for x in zip(*itertools.combinations(range(len(texts)), 2)))
    sets = [shingles(x) for x in texts]
    want = [100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]) for a, b in zip(i, j)]
    both = L.Sets(pa.array(texts))
    assert both.resembling(i, j, 60).tolist() == both.resembling(i, j, 60, probes=7).tolist() == want and sum(want) > 1


def test_buckets_give_pairs_or_members():
    key = np.array([1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 4], np.uint64)
    line = np.array([7, 5, 7, 1, 9, 9, 3, -2, 8, 6, 3])
    pairs, of, member = L.bucket_rows(key, line, 3)
    assert {tuple(p) for p in pairs.tolist()} == {(5, 7), (-2, 3), (-2, 6), (-2, 8)}
    assert sorted(zip(of.tolist(), member.tolist())) == [(4, 3), (4, 6), (4, 8)]
    pairs, of, _ = L.bucket_rows(key, line, 4)
    assert len(pairs) == 7 and len(of) == 0


def test_pairs_joined_and_keys_dealt_grow_with_lines_not_with_their_pairs(sp, monkeypatch):
    """Many lines in one bucket that resemble each other by less than the threshold: no join sees their pairs."""
    g = random.Random(8)
    base = [f"token{g.randrange(10 ** 6)}" for _ in range(40)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in g.sample(range(40), 6):
            words[at] = f"other{g.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    joined = []
    real = L.confirm
    monkeypatch.setattr(L, "confirm", lambda pairs, *a: (joined.append(pairs.count()), real(pairs, *a))[1])
    df = sp.createDataFrame(rows, "doc_id long, text string")
    want, all_pairs = brute(rows)
    assert gone(df) <= want and sum(joined) < all_pairs / 3
    packed = L.dealt_keys(L.line_table(df), 64).collect()
    assert sum(len(r["keys"]) for r in packed) == 120 * L.BANDS * L.KEY_BYTES and sum(len(r["lines"]) for r in packed) == 120 * L.BANDS * 8
