"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column.

A text is cut in slices of bounded size (a longer document is a slice of its
own), every byte gets one term of a polynomial, and running sums give the hash
of any stretch of bytes. Equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text worked on at once
SLICE_BYTES = 1 << 20

#: fixed values: the six characters that end a word, 0x20 and 0x09 to 0x0D
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: everything in ASCII but letters and digits ends a word; bytes above are letters
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", dtype=np.uint8)] = False
NOT_ALNUM[128:] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        row = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        row[0] = 1
        kept = np.multiply.accumulate(row)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = kept
    return kept[:n]


@dataclass
class Words:
    """The words of some documents. ``doc`` counts from ``first``."""

    first: int
    n_docs: int
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: running sums of the polynomial, one more than bytes
    sums: np.ndarray
    #: where each document's bytes begin, and the end
    at: np.ndarray

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the lower-cased bytes from ``start`` to ``end``."""
        if not len(start):
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start])

    def hashes(self) -> np.ndarray:
        return self.stretch(self.start, self.end)

    def counts(self) -> np.ndarray:
        """Words per document."""
        return np.bincount(self.doc, minlength=self.n_docs)


def slices(texts: pa.Array, ends: np.ndarray = BLANK, lower: bool = True) -> Iterator[Words]:
    """The words of all texts, a bounded number of bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        raw = data[offsets[first]:offsets[last]]
        at = offsets[first:last + 1] - offsets[first]
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = ~ends[raw]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        cut = at[:-1][at[:-1] < at[1:]]
        head[cut] |= inside[cut]
        start = np.flatnonzero(head)
        # a word ends before a blank, at the end of its document, or of the bytes
        tail = np.zeros(len(raw) + 1, dtype=bool)
        tail[1:] = inside[:-1] & ~inside[1:]
        tail[cut] |= inside[np.maximum(cut - 1, 0)] & (cut > 0)
        end = np.flatnonzero(tail)
        code = _LETTER[_LOWER[raw] if lower else raw]
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(code * _power(_BASE, len(raw)), out=sums[1:])
        doc = np.searchsorted(at, start, side="right") - 1
        yield Words(first, last - first, raw, start, end, doc, sums, at)
        first = last


def shingles(words: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` following words and the document of each.

    With ``short``, a document of fewer words gives one shingle of them all.
    """
    h, doc = words.hashes(), words.doc
    size = words.counts()
    total = len(h)
    out_h, out_doc = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if total >= n:
        acc = np.zeros(total - n + 1, dtype=np.uint64)
        for k in range(n):
            acc = acc * _BASE + h[k:total - n + 1 + k]
        whole = doc[:total - n + 1] == doc[n - 1:]
        out_h, out_doc = mix(acc[whole] + np.uint64(n)), doc[:total - n + 1][whole]
    if short:
        few = np.flatnonzero((size > 0) & (size < n))
        if len(few):
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            acc = np.zeros(len(few), dtype=np.uint64)
            for k in range(n - 1):
                has = size[few] > k
                acc[has] = acc[has] * _BASE + h[begin[few][has] + k]
            out_h = np.concatenate([out_h, mix(acc + size[few].astype(np.uint64))])
            out_doc = np.concatenate([out_doc, few])
    return out_h, out_doc


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per document, sorted by document and hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's stretch of a sorted ``doc`` begins, and the end."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
