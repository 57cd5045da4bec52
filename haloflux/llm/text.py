"""Vectorised words, word hashes and word shingles of Arrow text columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z.  A
word is hashed to 64 bits, a shingle combines the hashes of consecutive words.  Two different
shingles share a hash with probability 2**-64, so sets of hashes stand for sets of shingles.
A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text handled at once; a longer text is handled alone.
PIECE = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of the argument."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, PIECE + 1)
        base, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, base))), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, back))), dtype=np.uint64)
    return _powers, _inverse


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the offset of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text each, at least one row."""
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw(column)
    return _LOWER[data], offsets


def word_bounds(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text."""
    inside = ~_SPACE[low]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range."""
    powers, inverse = _tables(len(low))
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[: len(low)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts and the number of words before each text."""
    low, offsets = lowered(column)
    starts, ends, before = word_bounds(low, offsets)
    return span_hashes(low, starts, ends), before


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order and their number before each text.

    A text with fewer than ``size`` words, but at least one, has one shingle: all its words.
    """
    counts = np.diff(before)
    short = np.flatnonzero((counts > 0) & (counts < size))
    n = np.maximum(counts - size + 1, 0)
    n[short] = 1
    after = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(before[:-1] - after[:-1], n) + np.arange(after[-1])
    padded = np.concatenate((hashes, np.zeros(size, dtype=np.uint64)))
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + padded[at + k]
    for i in short:
        value = 0
        for h in hashes[before[i] : before[i + 1]]:
            value = (value * 0xA0761D6478BD642F + int(h) + int(counts[i])) & 0xFFFFFFFFFFFFFFFF
        total[after[i]] = value
    return mix(total), after


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    values, after = shingles(*words(column), size)
    return [distinct(values[after[i] : after[i + 1]]) for i in range(len(after) - 1)]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.concatenate(([True], values[1:] != values[:-1]))]
    return values
