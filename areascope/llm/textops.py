"""Vectorised text work on small batches of documents inside Arrow tasks.

A ``Chunk`` joins a few documents to one byte buffer with a line feed after each, so words and lines
never cross documents, and finds words (runs of bytes that are neither space nor TAB..CR) with their 64-bit
hashes by a polynomial prefix sum: a few numpy operations for each byte, none for each word in Python.
Memory is a fixed multiple of the chunk (``CHUNK_BYTES``, or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Chunk:
    """Documents ``texts`` (bytes) as one buffer with word and line positions."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        lengths = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.doc_end = np.cumsum(lengths + 1)            # one past the separator of each document
        self.doc_start = self.doc_end - lengths - 1
        self.solid = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(self.solid.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]    # the last byte is a separator: edges come in pairs
        self.first = np.searchsorted(self.start, self.doc_start)
        self.words = np.searchsorted(self.start, self.doc_end) - self.first   # of each document
        self.doc = np.repeat(np.arange(self.n), self.words)                    # of each word
        self._sums = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, equal for equal bytes."""
        n = len(self.buf)
        power, inverse = _powers(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[self.buf] * power[:n], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * inverse[start]
        return mix64(h + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of set bytes in each document."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.doc_end] - total[self.doc_start]

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word over each document."""
        total = np.zeros(len(values) + 1, np.int64 if values.dtype == bool else values.dtype)
        np.cumsum(values, out=total[1:])
        return total[self.first + self.words] - total[self.first]


def window_hash(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words that lie in one document, and their first words."""
    if len(words) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = h * _BASE + words[i:len(words) - k + 1 + i]
    at = np.flatnonzero(doc[k - 1:] == doc[:len(doc) - k + 1])
    return mix64(h[at]), at


def seen_twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether an earlier one is."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def by_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that tell apart equal hashes of different documents."""
    return mix64(hashes + mix64(doc.astype(np.uint64) + np.uint64(1)))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or one longer document."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
