"""Vectorised word and byte hashing of Arrow text columns.

A block of texts is handled as one byte array: a lookup table marks white space
(x20, x09-x0D), and the hash of a word is a difference of two prefix sums of
``table[byte] * BASE**position`` (arithmetic modulo 2**64), moved to position
zero by the inverse power. No Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds), element by element."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(29))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xE7037ED1A0B428DB))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1024)
        have = np.empty(size, U)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = before[1:] & solid[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum((_LOWER if lower else _BYTES)[data] * powers(n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(n, BASE_INV)[starts])
    return hashes, np.searchsorted(starts, offsets), starts, ends


def word_blocks(column: pa.Array, lower: bool = False, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, word offsets by row, byte starts, byte ends); starts and ends count from the first row's first byte.

    A row far longer than a block is hashed in segments cut after white space, so that memory beyond the words stays bounded.
    """
    data, offsets = text_bytes(column)
    for first, last in row_blocks(offsets, most):
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi - lo <= 4 * most:
            h, by_row, s, e = _words(data[lo:hi], offsets[first : last + 1] - lo, lower)
            yield first, last, h, by_row, s, e
            continue
        parts, at = [], lo
        while at < hi:
            to = min(at + most, hi)
            while to < hi and not SPACE[data[to - 1]]:
                gap = np.flatnonzero(SPACE[data[to : to + most]])
                to = to + int(gap[0]) + 1 if len(gap) else min(to + most, hi)
            h, _, s, e = _words(data[at:to], np.array([0, to - at]), lower)
            parts.append((h, s + (at - lo), e + (at - lo)))
            at = to
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield first, last, h, np.array([0, len(h)]), s, e


def shingles(hashes: np.ndarray, by_row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, offsets by row); a row with 1 to k-1 words has its whole sequence as its one run, an empty row none."""
    n, counts = len(hashes), np.diff(by_row)
    runs = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    at = by_row[:-1][row] + (np.arange(offsets[-1]) - offsets[:-1][row])
    out = np.zeros(len(at), U)
    end = by_row[1:][row]
    for j in range(k):
        here = at + j
        inside = here < end
        if n:
            out = np.where(inside, out * U(0xC2B2AE3D27D4EB4F) + hashes[np.minimum(here, n - 1)], out)
    return mix(out ^ np.minimum(counts, k).astype(U)[row]), offsets


def unique_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values row by row, and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value * BASE**position before each position and in all (values: bytes, or 64-bit hashes)."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((_BYTES[values] if values.dtype == np.uint8 else values) * powers(len(values)), out=sums[1:])
    return sums
