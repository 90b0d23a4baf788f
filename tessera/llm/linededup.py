"""Fuzzy line dedup by MinHash (operator 5): one line of each group of near-equal lines stays.

Lines are split at \\n; a line counts if it holds a word, and is compared lower-cased (A-Z) and
without white space at its ends.  Equal lines are one.  A line's set is its distinct shingles of
``SHINGLE`` characters (a shorter line is one shingle, so it only equals itself).

1. One pass over the texts: a line hash, one-permutation MinHash minima in BANDS x ROWS bins (empty
   bins borrow from others), whose bands are the candidate keys, and four bits of each minimum as a
   signature.  Lines that repeat within a slice leave it once, with their places.
2. Keys and line hashes are dealt by band and key in packed arrays, 13 bytes a key; each part finds its
   buckets of two or more different lines.  A bucket of up to ``small`` lines gives all its pairs, a
   larger one the pairs with its least line, and its other members for step 4.
3. Pairs are compared by signatures, then (texts are fetched only now) by exact Jaccard; confirmed links
   are merged by union-find.
4. Large buckets whose other members still lie in several components have those cross-component
   pairs compared in the same two steps where they are, in blocks of ``block`` lines spread over tasks:
   first signatures, then the texts of the lines that have a likely partner; only links leave a block.
5. Of each component the occurrence with the least (doc_id, line number) stays; all other
   occurrences are dropped from their documents.  Blank lines and text within lines never change.

At the threshold (0.8) one pair in 130 shares no band; at 0.85 one in 2,000.

Nulls and edge cases: a null or empty text has no lines and stays as it is; documents without an id
stay as they are and own no lines; rows that repeat an id are one document, so their lines are kept
or dropped alike; a text whose lines all go becomes empty; an empty table gives no rows; extra
columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytescan as B
from tessera.llm.common import binary_rows, bit_filter, by_batch, long_column, long_lists, materialise, passes, prepare, release, split_by, table
from tessera.llm.components import components

NAME = "op5_fuzzy_lines"
ORACLE_SQL = None  # tests hold it against brute force over all pairs of lines

SHINGLE = 4  # one changed character within a line of 39 characters or more leaves a Jaccard of 0.8
BANDS, ROWS = 16, 6
BINS = BANDS * ROWS  # minima of a line; four bits of each are its signature
KEY_BYTES = 5  # of a band's key: its buckets are told apart by 40 bits
KEYS_A_PART = 1 << 16  # keys of a part of a band, about
PACKED = 1 << 20  # keys that a task packs or groups at a time
SLICE = 1 << 18  # bytes of text worked on at a time (a longer document stands alone)
STRIPPED = 16  # characters of white space taken from a line's end one by one (longer stretches are looked up)
WIDE = 1 << 13  # rows of one Arrow batch of keys, signatures or places, which are of a fixed width
SLACK = 0.16  # a pair whose signatures estimate this much less than the threshold is not verified (four deviations)


def lines_of(buf: np.ndarray, offs: np.ndarray):
    """(start, end, document, line number) of every line with a word, white space at its ends
    stripped; line numbers count all \\n-split lines of the document from 0."""
    feeds = np.flatnonzero(buf == 10)
    s = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    s = s[s < len(buf)]
    doc, k = B.owner(offs, s), np.searchsorted(feeds, s)
    number = k - np.searchsorted(feeds, offs)[doc]
    e = np.minimum(np.append(feeds, len(buf))[k], offs[doc + 1])
    at = np.flatnonzero(B.SEPARATOR[buf[s]] & (s < e))  # lines with white space at the start
    for _ in range(STRIPPED):
        s[at] += 1
        at = at[s[at] < e[at]]
        at = at[B.SEPARATOR[buf[s[at]]]]
    if len(at):
        solid = np.append(np.flatnonzero(~B.SEPARATOR[buf]), len(buf))
        s[at] = np.minimum(solid[np.searchsorted(solid, s[at])], e[at])
    full = np.flatnonzero(s < e)
    s, e, doc, number = s[full], e[full], doc[full], number[full]
    at = np.flatnonzero(B.SEPARATOR[buf[e - 1]])  # (a word lies before it)
    for _ in range(STRIPPED):
        e[at] -= 1
        at = at[B.SEPARATOR[buf[e[at] - 1]]]
    if len(at):
        solid = np.flatnonzero(~B.SEPARATOR[buf])
        e[at] = solid[np.searchsorted(solid, e[at]) - 1] + 1
    return s, e, doc, number


_PLACE = np.random.default_rng(99).integers(1, 1 << 62, SHINGLE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def line_shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(hash, line) of every shingle of SHINGLE characters, lines ascending and apart; a shorter line
    is one shingle of its own (an empty one none).  All windows of the buffer are hashed at once from its code points."""
    data = buf.tobytes()
    point = buf if data.isascii() else np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    point = point.astype(np.uint64)
    if len(point) == len(buf):  # one byte a character
        a, b = start, end
    else:
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        a, b = lead[start], lead[end]
    h, part = point * _PLACE[0], np.empty_like(point)
    for k in range(1, min(SHINGLE, len(point))):
        h[:-k] += np.multiply(point[k:], _PLACE[k], out=part[k:])
    n = np.maximum(b - a - SHINGLE + 1, np.minimum(b - a, 1))
    line = np.repeat(np.arange(len(a)), n)
    inside = np.zeros(len(point) + SHINGLE + 1, np.int8)
    np.add.at(inside, a, 1)
    np.add.at(inside, a + n, -1)
    h = h[np.cumsum(inside[:len(point)], dtype=np.int8).view(bool)]
    for k in np.flatnonzero((b - a < SHINGLE) & (b > a)):
        at = np.arange(b[k] - a[k])
        h[np.searchsorted(line, k)] = (point[a[k] + at] * _PLACE[at]).sum(dtype=np.uint64) + np.uint64(len(at) + 1)
    part = part[:len(h)]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # (``bytescan.mix`` in place)
        h ^= np.right_shift(h, np.uint64(shift), out=part)
        h *= np.uint64(factor)
    h ^= np.right_shift(h, np.uint64(31), out=part)
    return h, line


SIGNATURE = [f"s{k}" for k in range(BINS // 16)]  # columns of a signature, 16 minima each


def line_bands(h: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines x BANDS) keys and (lines x BINS / 2) signature bytes from one-permutation minima; an empty
    bin takes the minimum of the first full bin on its own fixed probe sequence."""
    empty = np.uint64(2 ** 64 - 1)
    least = np.full(n * BINS, empty, np.uint64)
    at = h >> np.uint64(32)
    at *= np.uint64(BINS)
    at >>= np.uint64(32)
    at = at.view(np.int64)
    at += line * BINS
    np.minimum.at(least, at, h * np.uint64(0x9E3779B97F4A7C15))
    out = least.copy()
    at = np.flatnonzero(least == empty)
    first, col = np.divmod(at, BINS)
    first *= BINS
    g = np.random.default_rng(11)
    while len(at):
        got = least[first + g.integers(0, BINS, BINS)[col]]
        out[at] = got
        left = np.flatnonzero(got == empty)
        at, first, col = at[left], first[left], col[left]
    out = out.reshape(n, BINS)
    keys, rows = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], out.reshape(n, BANDS, ROWS)
    for r in range(ROWS):
        keys = B.mix(keys * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, r])
    code = ((out >> np.uint64(20)) & np.uint64(15)).astype(np.uint8)
    return keys, code[:, 0::2] | (code[:, 1::2] << 4)


def alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Estimated resemblance of signature rows, corrected for the minima that agree by chance (1 in 16)."""
    x = one ^ two
    same = (((x & 15) == 0).sum(1, dtype=np.int64) + ((x >> 4) == 0).sum(1, dtype=np.int64)) / BINS
    return (16 * same - 1) / 15


_LOWER = B.LOWER.tobytes()


def _slices(batch):
    """(ids, lower-cased bytes, offsets, start, end, document, number) of lines, some documents at a time."""
    ids = long_column(batch, "doc_id")
    buf, offs = B.text_buffer(batch.column("text"))
    for i, j in B.slices(offs, SLICE):
        o = offs[i:j + 1] - offs[i]
        low = np.frombuffer(buf[offs[i]:offs[j]].tobytes().translate(_LOWER), np.uint8)
        yield ids[i:j], low, o, *lines_of(low, o)


def line_table(docs: DataFrame) -> DataFrame:
    """``line, doc, number, docs, numbers, keys, s0, s1, ...``: distinct lines of each slice of documents, their
    least place there and the other places, band keys of KEY_BYTES each (null for a line shorter than a
    shingle, which only equals itself) and signature."""
    names = ["line", "doc", "number", "docs", "numbers", "keys", *SIGNATURE]

    def kernel(batch):
        parts = []
        for ids, low, _, s, e, doc, number in _slices(batch):
            h = B.span_hashes(low, s, e)
            order = np.lexsort((number, ids[doc], h))
            lead = np.ones(len(order), bool)
            lead[1:] = h[order[1:]] != h[order[:-1]]
            at = np.append(np.flatnonzero(lead), len(order))
            by_place = np.argsort(s[order[at[:-1]]])
            one, places = order[at[:-1]][by_place], pa.array(by_place)
            other, cuts = order[~lead], at - np.arange(len(at))
            hs, line = line_shingles(low, s[one], e[one])
            keys, sig = line_bands(hs, line, len(one))
            banded = np.bincount(line, minlength=len(one)) > 1
            banded |= e[one] - s[one] >= 4 * SHINGLE  # (so many bytes are a shingle at least)
            short = np.flatnonzero(~banded)
            banded[short] = [len(low[s[k]:e[k]].tobytes().decode("utf-8", "replace")) >= SHINGLE for k in one[short]]
            packed = binary_rows(_low_bytes(keys).reshape(len(one), BANDS * KEY_BYTES))
            parts.append(pa.RecordBatch.from_arrays([
                pa.array(h[one].view(np.int64)), pa.array(ids[doc[one]]), pa.array(number[one].astype(np.int64)),
                long_lists(ids[doc[other]], cuts).take(places), long_lists(number[other], cuts).take(places),
                pc.if_else(pa.array(banded), packed, pa.scalar(None, pa.binary())),
                *(pa.array(c) for c in np.ascontiguousarray(sig.view(np.int64).T))], names))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else None

    return docs.mapInArrow(by_batch(kernel), "line long, doc long, number long, docs array<long>, numbers array<long>, keys binary, "
                           + ", ".join(f"{c} long" for c in SIGNATURE))


def _low_bytes(keys: np.ndarray) -> np.ndarray:
    """The lower KEY_BYTES bytes of each number, one row for each."""
    return np.ascontiguousarray(keys.astype("<u8").reshape(-1, 1).view(np.uint8)[:, :KEY_BYTES])


def _from_low_bytes(packed: bytes) -> np.ndarray:
    rows = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :KEY_BYTES] = rows
    return out.view("<u8").ravel()


def dealt_keys(lines: DataFrame, parts: int) -> DataFrame:
    """``part, keys, lines``: the band keys and their lines, ``parts`` parts a band, packed."""
    def run(batches):
        held, count = [], 0

        def flush():
            line = np.concatenate([x for x, _ in held])
            key = _from_low_bytes(b"".join(k for _, k in held)).reshape(-1, BANDS)
            part = ((key % np.uint64(parts)).astype(np.int64) + np.arange(BANDS) * parts).ravel()
            order = np.argsort(part, kind="stable")
            there, first = np.unique(part[order], return_index=True)
            cut = np.append(first, len(order)).astype(np.int64)
            packed, owner = _low_bytes(key.ravel()[order]), line[order // BANDS]
            for i in range(0, len(there), 1024):
                j = min(i + 1024, len(there))
                yield pa.RecordBatch.from_arrays([
                    pa.array(there[i:j].astype(np.int32)),
                    pa.array([packed[x:y].tobytes() for x, y in zip(cut[i:j], cut[i + 1:j + 1])], pa.binary()),
                    pa.array([owner[x:y].tobytes() for x, y in zip(cut[i:j], cut[i + 1:j + 1])], pa.binary())], ["part", "keys", "lines"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("line").to_numpy(), b"".join(batch.column("keys").to_pylist())))
                count += batch.num_rows * BANDS
            if count >= PACKED:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return lines.where("keys is not null").select("line", "keys").mapInArrow(run, "part int, keys binary, lines binary")


def bucket_rows(key: np.ndarray, line: np.ndarray, small: int):
    """(pairs, keys, members) of the buckets of two or more different lines: all pairs of a bucket of up to
    ``small`` lines, else those with its least line, and the key and line of its other members."""
    order = np.argsort(key, kind="stable")
    key, line = key[order], line[order]
    same = key[1:] == key[:-1]
    often = np.append(same, False) | np.insert(same, 0, False)
    key, line = key[often], line[often]
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[new], line[new]
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(lead)
    group = np.cumsum(lead) - 1
    size = np.diff(np.append(first, len(key)))[group]
    begin, row = first[group], np.arange(len(key))
    large = (size > small) & ~lead
    pairs = [np.stack([line[begin[large]], line[large]], 1)]
    for step in range(1, small):
        at = row[(size <= small) & (row - begin >= step)]
        pairs.append(np.stack([line[at - step], line[at]], 1))
    return np.concatenate(pairs), key[large], line[large]


def _bucket_partitions(small: int, parts: int):
    """``bucket_rows`` over a partition of ``dealt_keys`` sorted by part, some PACKED keys at a time; a part is
    never cut.  Rows ``key, a, b``: a pair (without a key), or the key of a large bucket and its member b."""
    def run(batches):
        held, count, last = [], 0, None

        def work():
            key = np.concatenate([_from_low_bytes(k) | np.uint64(p // parts << 8 * KEY_BYTES) for p, k, _ in held])
            line = np.frombuffer(b"".join(x for _, _, x in held), np.int64)
            pairs, of, member = bucket_rows(key, line, small)
            n, m = len(pairs), len(of)
            return pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(of.astype(np.int64))]),
                pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.nulls(m, pa.int64())]),
                pa.array(np.concatenate([pairs[:, 1], member]))], ["key", "a", "b"])

        for batch in batches:
            for part, keys, lines in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "lines"))):
                if part != last and count >= PACKED:
                    yield work()
                    held, count = [], 0
                held.append((part, keys, lines))
                count += len(lines) // 8
                last = part
        if held:
            yield work()

    return run


def place_of(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One number for each place (document, line number), for a ``bit_filter``."""
    return B.mix(doc.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + number.astype(np.uint64)).view(np.int64)


def places_of(lines: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``place``: one place in each slice of the lines that the filter lets through."""
    def kernel(batch):
        batch = batch.filter(pa.array(passes(wanted, batch.column("line").to_numpy())))
        return pa.RecordBatch.from_arrays([pa.array(place_of(batch.column("doc").to_numpy(), batch.column("number").to_numpy()))], ["place"])

    return lines.select("line", "doc", "number").mapInArrow(by_batch(kernel), "place long")


def line_texts(docs: DataFrame, places: np.ndarray | None) -> DataFrame:
    """``line, text`` (lower-cased) of the lines at the places that the filter lets through: only these are hashed."""
    def kernel(batch):
        keys, texts = [], []
        for ids, low, _, s, e, doc, number in _slices(batch):
            at = np.flatnonzero(passes(places, place_of(ids[doc], number)))
            found = [low[x:y].tobytes() for x, y in zip(s[at], e[at])]
            texts += found
            cuts = np.concatenate([[0], np.cumsum(e[at] - s[at])]).astype(np.int64)
            keys.append(B.span_hashes(np.frombuffer(b"".join(found), np.uint8), cuts[:-1], cuts[1:]).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(texts, pa.binary()).cast(pa.string())], ["line", "text"])

    return docs.mapInArrow(by_batch(kernel), "line long, text string")


def likely_pairs(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures can belong to a resemblance of ``percent``: no text is moved
    for the others."""
    def kernel(batch):
        one, two = (np.stack([batch.column(x + c).to_numpy() for c in SIGNATURE], 1).view(np.uint8) for x in "ab")
        keep = pa.array(np.flatnonzero(100 * alike(one, two) >= percent - 100 * SLACK))
        return pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    sigs = lines.groupBy("line").agg(*(F.min(c).alias(c) for c in SIGNATURE))  # (a line has one signature)
    t = pairs.join(sigs.select(F.col("line").alias("a"), *(F.col(c).alias("a" + c) for c in SIGNATURE)), "a")
    t = t.join(sigs.select(F.col("line").alias("b"), *(F.col(c).alias("b" + c) for c in SIGNATURE)), "b")
    return t.mapInArrow(by_batch(kernel), "a long, b long")


class Sets:
    """The sets of distinct shingles of an Arrow column's texts, whose pairs are compared exactly.  ``code``
    holds (set, shingle hash) as one ascending number: the hash loses as many bits as the set's number
    takes (12 of 64 for 4,096 sets)."""

    def __init__(self, column):
        buf, offs = B.text_buffer(column)
        h, line = line_shingles(buf, offs[:-1], offs[1:])
        self.bits = np.uint64(64 - max(1, (len(offs) - 1).bit_length()))
        h >>= np.uint64(64) - self.bits
        h |= line.astype(np.uint64) << self.bits
        h.sort()
        self.code = h[np.append(True, h[1:] != h[:-1])] if len(h) else h
        self.size = np.bincount((self.code >> self.bits).view(np.int64), minlength=len(offs) - 1)
        self.first = np.cumsum(self.size) - self.size
        self.hash = self.code & np.uint64((1 << int(self.bits)) - 1)

    def resembling(self, i: np.ndarray, j: np.ndarray, percent: int, probes: int = 1 << 18) -> np.ndarray:
        """Mask of the pairs (i, j) whose Jaccard reaches ``percent``; about ``probes`` elements are looked up at a time."""
        size = self.size
        i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)  # (the smaller set is looked up)
        out = np.zeros(len(i), bool)
        near = np.flatnonzero((100 * size[i] >= percent * size[j]) & (size[i] > 0))
        if not len(near):
            return out
        done = np.cumsum(size[i[near]])
        cuts = np.unique(np.append(np.searchsorted(done, np.arange(0, done[-1], probes), "left"), len(near)))
        for x, y in zip(cuts[:-1], cuts[1:]):
            one, two = i[near[x:y]], j[near[x:y]]
            n = size[one]
            begin = np.cumsum(n) - n
            probe = self.hash[np.arange(n.sum()) + np.repeat(self.first[one] - begin, n)]
            probe |= np.repeat(two.astype(np.uint64) << self.bits, n)
            at = np.minimum(np.searchsorted(self.code, probe), len(self.code) - 1)
            inter = np.add.reduceat((self.code[at] == probe).astype(np.int64), begin)
            out[near[x:y]] = 100 * inter >= percent * (n + size[two] - inter)
        return out


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard reaches ``percent``."""
    def kernel(batch):
        both = np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
        _, one, of = np.unique(both, return_index=True, return_inverse=True)  # (a line meets several others)
        sets = Sets(pa.concat_arrays([batch.column("ta"), batch.column("tb")]).take(pa.array(one)))
        keep = pa.array(np.flatnonzero(sets.resembling(of[:batch.num_rows], of[batch.num_rows:], percent)))
        return pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    t = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("ta")), "a")
    t = t.join(texts.select(F.col("line").alias("b"), F.col("text").alias("tb")), "b")
    return t.select("a", "b", "ta", "tb").mapInArrow(by_batch(kernel), "a long, b long")


def cross_pairs(end: np.ndarray, line: np.ndarray, comp: np.ndarray, blk: np.ndarray, apart: np.ndarray, sig: np.ndarray,
                percent: int, large: int = 256):
    """Row pairs (i, j), some at a time, of the same group (``end``: where each row's group ends) whose components
    differ, whose blocks differ where ``apart``, and whose signatures can belong to ``percent``.  Small
    groups are compared all at once, neighbour by neighbour; in a large one only rows outside its largest
    component meet the others."""
    def near(i, j):
        ok = (comp[i] != comp[j]) & (~apart[i] | (blk[i] != blk[j]))
        i, j = i[ok], j[ok]
        ok = 100 * alike(sig[i], sig[j]) >= percent - 100 * SLACK
        return i[ok], j[ok]

    row = np.arange(len(end))
    begin = np.searchsorted(end, end)  # (a group's rows share their end, so its first row is the first with it)
    size = end - begin
    step, left = 1, row[(size <= large) & (row + 1 < end)]
    while len(left):
        yield near(left, left + step)
        step += 1
        left = left[left + step < end[left]]
    for first in np.unique(begin[size > large]):
        group = np.arange(first, end[first])
        values, counts = np.unique(comp[group], return_counts=True)
        main = comp[group] == values[np.argmax(counts)]
        for i in group[~main]:  # every cross-component pair has a member outside the largest
            j = group[main | (line[group] > line[i])]
            yield near(np.full(len(j), i), j)


_BLOCK = ["key", "b1", "b2", "line", "comp", "blk", *SIGNATURE]


def _by_groups(work, rows: int = 1 << 14):
    """``work(table, end)`` over a partition sorted by (key, b1, b2), some ``rows`` at a time (``end``: where each
    row's group ends); a group is never cut, and holds about two blocks of lines at most."""
    def run(batches):
        held, count = [], 0

        def whole(last: bool):
            t = pa.Table.from_batches(held)
            c = [t.column(n).to_numpy() for n in ("key", "b1", "b2")]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in c], axis=0)
            first = np.flatnonzero(new)
            stop = t.num_rows if last else int(first[-1])
            end = np.append(first, t.num_rows)[np.searchsorted(first, np.arange(stop), "right")]
            return work(t.slice(0, stop), end), t.slice(stop)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= rows:
                out, rest = whole(False)
                held, count = rest.to_batches(), min(rest.num_rows, rows // 2)
                yield from out
        if held:
            yield from whole(True)[0]

    return run


def _near_of(t: pa.Table, end: np.ndarray, percent: int):
    line, comp, blk, b1, b2 = (t.column(n).to_numpy() for n in ("line", "comp", "blk", "b1", "b2"))
    sig = np.stack([t.column(c).to_numpy() for c in SIGNATURE], 1).view(np.uint8)
    return cross_pairs(end, line, comp, blk, b1 != b2, sig, percent)


def near_members(percent: int):
    """Rows of a block that have a partner by ``cross_pairs``: only their texts will be needed."""
    def work(t, end):
        found = np.zeros(t.num_rows, bool)
        for i, j in _near_of(t, end, percent):
            found[i] = found[j] = True
        return t.filter(pa.array(found)).to_batches()

    return _by_groups(work)


def block_links(percent: int):
    """Links (a, b) of a block: its ``cross_pairs`` whose exact Jaccard reaches ``percent``."""
    def work(t, end):
        sets, line = Sets(t.column("text")), t.column("line").to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for i, j in _near_of(t, end, percent):
            ok = sets.resembling(i, j, percent)
            out.append(np.sort(np.stack([line[i[ok]], line[j[ok]]], 1), axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], ["a", "b"])]

    return _by_groups(work, 1 << 11)  # (texts and their shingles are held)


def duplicate_lines(docs: DataFrame, percent: int = 80, block: int = 2048, filter_bits: int | None = None, small: int = 8) -> DataFrame:
    """``doc_id, number`` of every line occurrence that goes."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = materialise(line_table(docs), "lines")
    parts = max(64, lines.count() // KEYS_A_PART)
    dealt = dealt_keys(lines, parts).repartition("part").sortWithinPartitions("part")
    found = materialise(dealt.mapInArrow(_bucket_partitions(small, parts), "key long, a long, b long"), "buckets", WIDE)
    likely = materialise(likely_pairs(found.where("key is null").select("a", "b").distinct(), lines, percent), "pairs", WIDE)
    members = found.where("key is not null").select("key", F.col("b").alias("line"))
    texts = _texts_of(docs, lines, likely.select(F.col("a").alias("line")).union(likely.select("b")), filter_bits)
    links = materialise(confirm(likely, texts, percent), "links")
    release(likely, texts)
    comp = components(links)
    # (all pairs with a bucket's least line are decided: only a large bucket's other members can still differ)
    tagged = (members.join(comp.select(F.col("v").alias("line"), "root"), "line", "left")
              .select("key", "line", F.coalesce("root", "line").alias("comp")))
    still = (tagged.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("size"))
             .where("c1 < c2").select("key", F.ceil(F.col("size") / block).cast("int").alias("n_blk")))
    rest = materialise(tagged.join(still, "key"), "members")
    unsettled = bit_filter(rest, "line", filter_bits)

    def own_signature(batch):
        return batch.filter(pa.array(passes(unsettled, batch.column("line").to_numpy())))

    sigs = lines.select("line", *SIGNATURE).mapInArrow(by_batch(own_signature), ", ".join(f"{c} long" for c in ["line", *SIGNATURE]))
    t = (rest.withColumn("blk", F.pmod(F.xxhash64("line"), F.col("n_blk")).cast("int"))
         .join(sigs.groupBy("line").agg(*(F.min(c).alias(c) for c in SIGNATURE)), "line")
         .select("*", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("o"))
         .withColumn("b1", F.least("blk", "o")).withColumn("b2", F.greatest("blk", "o")).select(*_BLOCK))
    by_block = lambda t: t.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "line")
    near = materialise(by_block(t).mapInArrow(near_members(percent), t.schema), "near", WIDE)
    texts = _texts_of(docs, lines, near.select("line"), filter_bits)
    t = by_block(near.join(texts, "line").select(*_BLOCK, "text"))
    more = materialise(t.mapInArrow(block_links(percent), "a long, b long").distinct(), "links")
    release(found, rest, near, texts)
    final = components(comp.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    # owners: the first occurrence in each component of the lines that occur more than once or have links
    first = F.struct(F.col("doc").alias("doc_id"), "number")
    once = lines.groupBy("line").agg(F.sum(F.size("docs") + 1).alias("n"), F.min(first).alias("at"))
    tied = final.select(F.col("v").alias("line"), "root").unionByName(final.select(F.col("root").alias("line"), "root").distinct())
    grouped = once.join(tied, "line", "left").where("n > 1 or root is not null").select("line", F.coalesce("root", "line").alias("root"), "at")
    grouped = materialise(grouped, "grouped")
    owners = grouped.groupBy("root").agg(F.min("at").alias("at"))
    owner_of = materialise(grouped.select("line", "root").join(owners, "root")
                           .select("line", F.col("at.doc_id").alias("own_doc"), F.col("at.number").alias("own_number")), "owners")
    release(links, more, comp, final, grouped)
    owned = bit_filter(owner_of, "line", filter_bits)

    def occurrences(batch):
        batch = batch.filter(pa.array(passes(owned, batch.column("line").to_numpy())))
        line, places = batch.column("line").to_numpy(), batch.column("docs")
        others = pa.array(np.repeat(line, pc.list_value_length(places).to_numpy()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (
            [batch.column("doc"), places.flatten()], [batch.column("number"), batch.column("numbers").flatten()],
            [batch.column("line"), others])], ["doc_id", "number", "line"])

    seen = lines.select("line", "doc", "number", "docs", "numbers").mapInArrow(by_batch(occurrences), "doc_id long, number long, line long")
    gone = seen.join(owner_of, "line").where("doc_id <> own_doc or number <> own_number").select("doc_id", "number")
    gone = materialise(gone, "gone", WIDE)
    release(lines, owner_of)
    return gone


def _texts_of(docs: DataFrame, lines: DataFrame, wanted: DataFrame, filter_bits: int | None) -> DataFrame:
    """``line, text`` of the wanted lines, read at their places."""
    wanted = materialise(wanted.distinct(), "wanted")
    places = materialise(places_of(lines, bit_filter(wanted, "line", filter_bits)), "places", WIDE)
    found = line_texts(docs, bit_filter(places, "place", filter_bits)).join(wanted, "line", "left_semi")
    out = materialise(found.groupBy("line").agg(F.min("text").alias("text")), "texts")
    release(wanted, places)
    return out


def dropped_lines(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, dropped`` (ascending line numbers) of the documents that lose lines."""
    return duplicate_lines(docs, **options).groupBy("doc_id").agg(F.sort_array(F.collect_set("number")).alias("dropped"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the duplicate lines cut out of ``text``; all rows and columns stay.  Only documents
    that may lose a line (a bit filter tells) meet the join with the lines that go."""
    gone = materialise(dropped_lines(docs, **options).select(F.col("doc_id").alias("_id"), F.col("dropped").alias("_dropped")), "dropped")
    maybe, others = split_by(docs, bit_filter(gone, "_id"))
    t = maybe.join(gone, F.col("doc_id").cast("long") == F.col("_id"), "left").select(*(maybe[c] for c in docs.columns), "_dropped")
    names = list(docs.columns)
    where = names.index("text")

    def kernel(batch):
        texts, lost = batch.column("text").to_pylist(), batch.column("_dropped").to_pylist()
        for k, drop in enumerate(lost):
            if drop and texts[k]:
                drop = set(drop)
                texts[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in drop)
        cols = [batch.column(k) for k in range(len(names))]
        cols[where] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(cols, names)

    return others.unionByName(t.mapInArrow(by_batch(kernel), docs.schema))


def line_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines``: lines with a word in each document."""
    def kernel(batch):
        buf, offs = B.text_buffer(batch.column("text"))
        n = [np.bincount(lines_of(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])[2], minlength=j - i) for i, j in B.slices(offs, SLICE)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(n).astype(np.int64))], ["doc_id", "n_lines"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(by_batch(kernel), "doc_id long, n_lines long")


def query(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gone = dropped_lines(docs).select(F.col("doc_id").alias("_id"), "dropped")
    out = line_counts(docs).join(gone, F.col("doc_id") == F.col("_id"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<long>"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))
