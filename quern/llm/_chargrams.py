"""Hashed character n-grams of Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._words import U, chunks, mix, text_buffers

_BASE = 0x9E3779B97F4A7C15


def _lut() -> np.ndarray:
    """Lower-case ASCII letters and one kind of white space; digits count alike."""
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    lut[9:14] = 32
    lut[48:58] = 48
    return lut


_LUT = _lut()


def grams(column: pa.Array, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each text the hashed places (below 2**bits, in order, repeated ones repeatedly) of all its n-grams of UTF-8 bytes.

    A blank stands before and after each text; a null text counts as empty.
    """
    off, raw = text_buffers(column)
    for at, end in chunks(off):
        lo = int(off[at])
        docs = off[at : end + 1] - lo
        n = end - at
        b = np.full(int(docs[-1]) + 2 * n, 32, np.uint8)
        place = np.arange(int(docs[-1])) + 2 * np.repeat(np.arange(n), np.diff(docs)) + 1
        b[place] = _LUT[raw[lo : int(off[end])]]
        starts = docs + 2 * np.arange(n + 1)
        codes = mix(np.arange(256, dtype=np.uint64))[b]
        hashes = []
        for k in sizes:
            if len(codes) < k:
                hashes.append(np.zeros(0, np.int32))
                continue
            h = np.zeros(len(codes) - k + 1, U)
            for i in range(k):
                h *= U(_BASE)
                h += codes[i : len(codes) - k + 1 + i]
            h ^= h >> U(32)
            h *= U(0xD6E8FEB86659FD93)
            hashes.append((h >> U(64 - bits)).astype(np.int32))
        for d in range(n):
            yield np.concatenate([h[starts[d] : max(starts[d], starts[d + 1] - k + 1)] for h, k in zip(hashes, sizes)])


def distinct(places: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sorted distinct places; ``flags``: a zeroed bool array of all places, zeroed again."""
    if len(places) * 8 < len(flags) // 8:
        return np.unique(places)
    flags[places] = True
    out = np.flatnonzero(flags).astype(np.int32)
    flags[out] = False
    return out
