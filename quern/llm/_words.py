"""Vectorised hashing of words and word n-grams over Arrow text batches.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR of
the UTF-8 text, which is ``[^\\x20\\x09-\\x0D]+``.  Hashes are 64-bit and do not
depend on the process, the batch or the machine.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = (1 << 19) - 1
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


@lru_cache(maxsize=4)
def _tables(lower: bool) -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[9:14] = 32
    if lower:
        lut[65:91] += 32
    return lut


def release() -> None:
    """Give memory that was freed back to the system; a worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose every output bit depends on every input bit."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two parts; for either part given, a bijection of the other."""
    return mix(a + (b ^ (b >> U(31))) * U(0xD6E8FEB86659FD93))


def runs(w: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n word hashes, across documents too.

    Runs are joined from two halves, which overlap where n is no power of two.  A sum of multiples of the words, modulo 2**64,
    would do with fewer steps, but different sequences of a regular build have equal sums then.
    """
    if len(w) < n:
        return np.zeros(0, U)
    h, m = mix(w ^ U(salt)), 1
    while 2 * m <= n:
        h, m = join(h[:-m], h[m:]), 2 * m
    return join(h[: len(h) - (n - m)], h[n - m :]) if m < n else h


def _word_hashes(b: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``length`` bytes at ``start``: every block of eight bytes is mixed with its number, then added."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))
    key = mix(np.zeros(1, U))
    total = mix((eight[start] & _MASKS[np.minimum(length, 8)]) + key)
    long = np.flatnonzero(length > 8)
    if len(long):
        n = (length[long] - 1) >> 3  # further blocks
        first = np.cumsum(n) - n
        j = np.arange(n.sum()) - np.repeat(first, n) + 1
        block = eight[np.repeat(start[long], n) + 8 * j] & _MASKS[np.minimum(np.repeat(length[long], n) - 8 * j, 8)]
        total[long] += np.add.reduceat(mix(block + mix(np.arange(n.max() + 1, dtype=U))[j]), first)
    return mix(total + length.astype(U))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off, raw


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` bytes, or of one longer document."""
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class Words:
    """Words of documents at..end of a text column: hashes and where each document's words begin."""

    def __init__(self, off: np.ndarray, raw: np.ndarray, at: int, end: int, lower: bool):
        lo, hi = int(off[at]), int(off[end])
        b = _tables(lower)[raw[lo:hi]]
        docs = off[at : end + 1] - lo
        self.n_docs = end - at
        solid = b != 32
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edges = docs[:-1][docs[:-1] < len(b)]
        first[edges] |= solid[edges]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = docs[1:][docs[1:] > 0] - 1
        last[edges] |= solid[edges]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.hash = _word_hashes(b, starts, ends - starts)
        self.first = np.searchsorted(starts, docs).astype(np.int64)  # n_docs + 1 places in hash
        self.count = np.diff(self.first)

    def doc_of(self, n: int) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.maximum(self.count - (n - 1), 0))

    def grams(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one document, and n_docs + 1 places where each document's begin."""
        w = self.hash
        per = np.maximum(self.count - (n - 1), 0)
        places = np.concatenate(([0], np.cumsum(per)))
        if len(w) < n:
            return np.zeros(0, U), places
        g = runs(w, n, salt)
        where = np.arange(len(g))
        doc = np.searchsorted(self.first, where, "right") - 1
        return g[where + n <= self.first[doc + 1]], places

    def shingle_sets(self, n: int) -> Iterator[np.ndarray]:
        """For each document the sorted distinct hashes of its n-word shingles; with fewer words the one of the whole sequence."""
        g, places = self.grams(n)
        for d in range(self.n_docs):
            if self.count[d] >= n:
                yield np.unique(g[places[d] : places[d + 1]])
            elif self.count[d]:
                w = self.hash[self.first[d] : self.first[d + 1]]
                whole = w[:1]
                for k in range(1, len(w)):
                    whole = join(whole, w[k : k + 1])
                yield mix(whole + U(len(w)))
            else:
                yield np.zeros(0, U)
