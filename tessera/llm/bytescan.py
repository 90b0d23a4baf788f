"""Vectorised scans over Arrow string columns: words, lines, hashes, per-document sums.

Kernels here look at one Arrow batch as a flat byte buffer plus document
offsets, so that a batch of texts costs a fixed number of numpy passes instead
of a Python step per word.  Everything is pure numpy: no state, no files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
# The word separators of every contract here: blank, tab, \n, \v, \f, \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20_240_917).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0]:offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 21):
    """(first, last) document ranges of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` that stay within one document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < len(inside)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word ``[^\\x20\\x09-\\x0D]+``."""
    s, e = runs(~SEPARATOR[buf], offs)
    return s, e, owner(offs, s)


def owner(offs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document that byte ``at`` lies in."""
    return np.searchsorted(offs, at, "right") - 1


_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, segment: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span (sorted by start, ends ascending): differences of a
    rolling prefix sum, shifted back to position 0."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + segment)))
        a, b = int(start[i]), int(end[j - 1])
        power, back = _power_tables(b - a + 1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[buf[a:b]] * power[: b - a], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * back[s]
        i = j
    return mix(out)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of all k-token windows that lie within one document.
    ``h``: token hashes; ``doc``: their documents, ascending."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[i:n + i])
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return out[at], at


def first_of_doc(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets (n_docs + 1) into arrays sorted by document."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, sorted by document, then hash."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    if len(d):
        keep = np.empty(len(d), bool)
        keep[0] = True
        keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        d, v = d[keep], v[keep]
    return d, v


def reduce_docs(op: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """``op`` over each document's run of ``values`` (``first``: offsets), ``empty`` where there is none."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    has = np.flatnonzero(first[1:] > first[:-1])
    if len(has):
        out[has] = op.reduceat(values, first[:-1][has], axis=0)
    return out
