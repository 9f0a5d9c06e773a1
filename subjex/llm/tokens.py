"""Vectorised word hashing over Arrow text columns (used inside tasks).

A word is a run of bytes other than ASCII white space, which equals ``[^\\x20\\x09-\\x0D]+``
on UTF-8 text.  Words are hashed without making Python strings: the bytes of a word weigh
powers of an odd base modulo 2**64 and are summed, and the sum is divided by the power at
the word's start.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
SLAB = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b))


@lru_cache(maxsize=8)
def _codes(seed: int, lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=U) + U(seed * 1000)) | U(1)
    if lower:
        codes[65:91] = codes[97:123]
    codes[[32, 9, 10, 11, 12, 13]] = 0
    return codes


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return (np.cumprod(np.r_[U(1), np.full(n - 1, _BASE, U)]), np.cumprod(np.r_[U(1), np.full(n - 1, inverse, U)]))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all words, and the number of words before each offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edges = offsets[offsets < len(data)]
    first[edges] = ~space[edges]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), U)
    codes, i = _codes(seed, lower), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLAB, "right")) - 1)
        end = starts[j] if j < len(starts) else len(data)
        part = data[starts[i]:end]
        power, inverse = _powers(max(SLAB, 1 << len(part).bit_length()))
        at = starts[i:j] - starts[i]
        out[i:j] = np.add.reduceat(codes[part] * power[:len(part)], at) * inverse[at]
        i = j
    return mix(out)


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries, by doubling."""
    if len(words) < k:
        return np.zeros(0, U)
    doubled, width = {1: words}, 1
    while width * 2 <= k:
        h = doubled[width]
        doubled[width * 2] = pair(h[:-width], h[width:])
        width *= 2
    out, at = None, 0
    for width in sorted(doubled, reverse=True):
        if k & width:
            if out is None:
                out, at = doubled[width], width
            else:
                n = len(words) - at - width + 1
                out = pair(out[:n], doubled[width][at:at + n])
                at += width
    return out


def slices(offsets: np.ndarray, most: int):
    """Cut documents into runs of at most ``most`` bytes (a longer document alone): (from, to)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
