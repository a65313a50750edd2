"""Vectorised byte-level helpers for Arrow string columns.

A *chunk* is a run of whole texts laid end to end in one byte array, cut so that the work arrays of a task stay a few
tens of MB however large the Arrow batch is. A single text larger than the chunk size is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None

#: Bytes folded by lower-casing A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """Lookup table of the bytes in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if invert else table


#: Anything but space and the ASCII white space tab to carriage return.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: Letters and digits of ASCII (after or before case folding) and all bytes of non-ASCII characters.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive runs of at most `limit` bytes, or of one text."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table`, never across texts, and each text's first run (n + 1)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, _BASE_INVERSE, np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values by prefix sums, then scrambled with the length."""
    power, inverse = _power_tables(len(data) + 1)
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + length * np.uint64(0xA24BAED4963EE407))


def windows(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, a shorter text with words being one window.

    words: word hashes laid end to end; first: each text's first word (n + 1). Returns the hashes, the index of each
    window's first word, and each text's first window (n + 1).
    """
    counts = np.diff(first)
    n_windows = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offset = np.concatenate(([0], np.cumsum(n_windows)))
    at = np.arange(offset[-1]) + np.repeat(first[:-1] - offset[:-1], n_windows)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    short = np.repeat(counts < k, n_windows)
    left = np.repeat(first[1:], n_windows) - at
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        term = padded[at + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1) | 1)
        if short.any():
            term = np.where(left > j, term, np.uint64(0))
        total += mix(term + np.uint64(j)) * (left > j) if short.any() else mix(term + np.uint64(j))
    length = np.minimum(left, k).astype(np.uint64)
    return mix(total + length), at, offset


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
