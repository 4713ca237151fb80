"""Vectorised hashing of UTF-8 columns in Arrow batches: words, shingles, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one step works on at once; a longer text is a step of its own.
STEP_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the worker's life."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, STEP_BYTES + 1024)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, lower-cased A-Z, and each row's first word's index (one more at the end)."""
    base = offsets[0]
    part, offs = data[base : offsets[-1]], offsets - base
    n = len(part)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[part]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), n), out=sums[1:])
    inverse = pow(int(_BASE), -1, 1 << 64)
    h = (sums[e] - sums[s]) * powers(inverse, n)[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(s, offs)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the rows' k-word shingles, and row offsets into them.

    A row with fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    words, first = word_hashes(data, offsets)
    q = np.uint64(0xA0761D6478BD642F | 1)
    n = len(words) - k + 1
    if n > 0:
        g = words[:n].copy()
        for j in range(1, k):
            g = g * q + words[j : j + n]
        g = mix(g)
    else:
        g = np.zeros(0, np.uint64)
    parts, sizes = [], np.zeros(len(offsets), dtype=np.int64)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            own = np.sort(g[a : b - k + 1])
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            h = 0x1234567 + (b - a)
            for w in words[a:b]:
                h = (h * int(q) + int(w)) & _MASK
            own = mix(np.array([h], dtype=np.uint64))
        else:
            continue
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of UTF-8 bytes as an Arrow string column."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
