"""Strings of Arrow batches as byte blocks for vectorised work on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18  # of text that vectorised steps hold at once, about 20 times as much in numbers; a longer text is a block of its own

SPACE = np.zeros(256, bool)  # the white space of the contracts
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def plain(column) -> pa.Array:
    """One array of strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, row offsets into them) for runs of rows of bounded size."""
    texts = plain(column)
    if len(texts) == 0:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last, data[bounds[first]:bounds[last]], bounds[first:last + 1] - bounds[first]
        first = last


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row of each byte position."""
    return np.searchsorted(offsets, at, "right") - 1


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end at white space and at the end of a row."""
    if len(data) == 0:
        return (np.empty(0, np.int64),) * 3
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    closes = offsets[1:] - 1
    closes = closes[closes >= 0]
    ends[closes] = word[closes]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, row_of(offsets, starts)


def mix64(v: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit numbers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.cumprod(held)
        if size <= 4 * BLOCK_BYTES:
            _POWERS[base] = held
    return held[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum."""
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=total[1:])
        value = (total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
        return mix64(value + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words inside one row."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    count = len(words) - n + 1
    value = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            value = mix64(value + words[i:i + count] + np.uint64(i + 1))
    inside = rows[:count] == rows[n - 1:]
    return value[inside], rows[:count][inside]


def binary_column(blob: np.ndarray, width: int) -> pa.Array:
    """Equally long byte strings, ``blob`` holding them one after the other."""
    rows = blob.nbytes // width
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32)),
                                                     pa.py_buffer(np.ascontiguousarray(blob))])
