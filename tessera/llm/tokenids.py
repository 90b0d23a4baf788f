"""Token ids of whole texts with the tokenizers library, each distinct unit encoded once.

Byte-pair merges never cross the pre-tokens of these tokenizers.  A cut directly before an ASCII
blank or line end that follows a non-blank, and a cut between a Latin letter and ASCII
punctuation, is always a pre-token boundary.  So a batch of texts is cut into such units in
numpy, units are compared by a 64-bit hash, each unit new to the worker is encoded by the
library, and a text's ids are its units' ids in a row.  What a worker remembers is bounded; units
beyond the bound are encoded again in each batch.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from tessera.llm import bytescan as B


def _set(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


_BLANK = _set((9, 10), (13, 13), (32, 32))
_ANY_BLANK = _set((9, 13), (0x1C, 0x20))
_LETTER = _set((65, 90), (97, 122))
_PUNCTUATION = _set((33, 47), (58, 64), (91, 96), (123, 126))
# Last bytes of the white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000).
_BLANK_TAIL = _set((0x80, 0x8A), (0x9F, 0xA0), (0xA8, 0xA9), (0xAF, 0xAF))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (never copied)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _before(mask: np.ndarray, k: int) -> np.ndarray:
    """mask shifted: whether the byte ``k`` places earlier has the property."""
    out = np.zeros(len(mask), bool)
    out[k:] = mask[:-k] if k < len(mask) else False
    return out


def units(buf: np.ndarray, offs: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of all documents, in order.  ``keep_blanks``: a unit begins
    with the white space before it; else blanks are dropped (the tokenizer ignores them)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    latin = _before(buf == 0xC3, 1) & (buf != 0x97) & (buf != 0xB7) & (buf >= 0x80)
    cut = _PUNCTUATION[buf] & _before(_LETTER[buf] | latin, 1)
    blank = _BLANK[buf]
    if keep_blanks:
        tail = _BLANK_TAIL[buf]
        wide = (tail & _before((buf >= 0xE1) & (buf <= 0xE3), 2)) | (tail & _before(buf == 0xC2, 1))
        cut |= blank & ~_before(_ANY_BLANK[buf] | wide, 1)
        cut[0] = True
        cut[offs[:-1][offs[:-1] < len(buf)]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(buf))
    inside = ~blank
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    begin = inside & (cut | first[:-1] | ~_before(inside, 1))
    start = np.flatnonzero(begin)
    stop = np.ones(len(buf), bool)  # the byte after ends the unit
    stop[:-1] = ~inside[1:] | begin[1:]
    return start, np.flatnonzero(inside & stop) + 1


class UnitEncoder:
    """Ids of the texts of an Arrow string column."""

    def __init__(self, path: str, keep_blanks: bool, fold_case: bool, max_units: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # units come once: the library's own word cache only costs
        self.keep_blanks, self.fold_case, self.max_units = keep_blanks, fold_case, max_units
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each unit)."""
        ids, sizes = [], []
        for i in range(0, len(texts), 50_000):
            part = texts[i:i + 50_000]
            got = self.tokenizer.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(got.ids, np.uint32))
            sizes.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes).astype(np.int32)

    def _tables(self, h: np.ndarray, example: np.ndarray, buf, start, end):
        """(key, at, size, pool) that hold all hashes ``h`` (sorted); remembered if there is room."""
        pos = np.minimum(np.searchsorted(self.key, h), max(len(self.key) - 1, 0))
        new = np.flatnonzero(self.key[pos] != h) if len(self.key) else np.arange(len(h))
        if not len(new):
            return self.key, self.at, self.size, self.pool
        data = buf.tobytes()
        ids, size = self._encode([data[start[k]:end[k]].decode("utf-8") for k in example[new]])
        at = len(self.pool) + np.concatenate([[0], np.cumsum(size[:-1], dtype=np.int64)])
        key = np.concatenate([self.key, h[new]])
        order = np.argsort(key, kind="stable")
        tables = (key[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order],
                  np.concatenate([self.pool, ids]))
        if len(key) <= self.max_units:
            self.key, self.at, self.size, self.pool = tables
        return tables

    def encode(self, column: pa.Array, limit: int = 1 << 22):
        """Yields (first document, ids, offsets): the ids of runs of documents; a null text is empty."""
        buf, offs = B.text_buffer(column)
        for i, j in B.slices(offs, limit):
            b, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            b = B.LOWER[b] if self.fold_case else b
            start, end = units(b, o, self.keep_blanks)
            h, example, inv = np.unique(B.span_hashes(b, start, end), return_index=True, return_inverse=True)
            key, at, size, pool = self._tables(h, example, b, start, end)
            pos = np.searchsorted(key, h)
            n = size[pos][inv].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(n)])
            ids = pool[np.repeat(at[pos][inv] - total[:-1], n) + np.arange(total[-1])]
            yield i, ids, total[np.searchsorted(start, o)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, keep_blanks: bool, fold_case: bool) -> UnitEncoder:
    """One encoder for each vocabulary in a Python worker."""
    return UnitEncoder(path, keep_blanks, fold_case)


def byte_bpe(path: str | None = None) -> tuple:
    """Encoder arguments of the byte-level vocabulary: blanks and case count."""
    return (path or tokenizer_path("byte_bpe_50k.json"), True, False)


def word_bpe(path: str | None = None) -> tuple:
    """Encoder arguments of the word vocabulary: blanks are dropped, case is folded."""
    return (path or tokenizer_path("word_bpe_49k.json"), False, True)
