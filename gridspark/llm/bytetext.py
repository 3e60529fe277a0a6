"""Texts of an Arrow column as numpy bytes: words, their hashes and shingles, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
"""Texts are handled in groups of about this many bytes, so arrays of eight bytes for each byte stay small."""

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)  # odd: powers never vanish


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_BYTE_VALUE[[9, 10, 11, 12, 13, 32]] = 0  # space lies between words and adds nothing


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text makes a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def is_space(data: np.ndarray) -> np.ndarray:
    """Blank, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of non-space bytes, and for each row the index of its first word (n+1 entries).

    ``offsets`` start at 0 within ``data``. Rows lie side by side, so a row's bounds also bound words.
    """
    solid = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    lo, hi = starts[0], ends[-1]
    gaps = np.diff(np.append(starts, hi))
    inside = np.arange(hi - lo) - np.repeat(starts - lo, gaps)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
        powers[-1] = 0  # for all that lies between words
        np.minimum(inside, len(powers) - 1, out=inside)
        value = _BYTE_VALUE[data[lo:hi]] * powers[inside]
        return mix(np.add.reduceat(value, starts - lo) + length.astype(np.uint64))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words of one text; a text of fewer words (but one) makes one window."""
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        width = min(k, n)
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for j in range(width):
            out = out * _BASE + hashes[j : n - width + 1 + j]
        return mix(out)
