"""Words and word shingles of whole Arrow batches as 64-bit numbers, by numpy on the UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes that part words: space and 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that part words when only ASCII letters, digits and bytes of longer characters make them.
NOT_WORD = np.array([not (chr(i).isascii() and chr(i).isalnum() or i > 127) for i in range(256)])

_powers = {"n": 0, "up": np.ones(0, np.uint64), "down": np.ones(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the system when a task ends; a worker process serves many tasks in turn and
    would hold the most that any of them took."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = 1 << 20, rows: int = 500) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column: first row, bytes, offsets of the rows in them. Nulls are empty.

    A run holds about ``most`` bytes, or one longer text whole.
    """
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    for base in range(0, len(column), rows):  # copies are made of few rows at a time
        part = column.slice(base, rows).fill_null("").cast(pa.large_string())
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(part):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield base + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def word_numbers(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number for each word, in order, and ``bounds``: row i has the words from bounds[i] to bounds[i + 1]."""
    value = np.where(parts, np.uint64(0), _VALUE)
    if lower:
        value[65:91] = value[97:123]
    inside = ~parts[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    starts[at] = inside[at]
    starts = np.flatnonzero(starts)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    up, down = _power_tables(len(data))
    sums = np.add.reduceat(value[data] * up[: len(data)], starts)
    return mix(sums * down[starts]), bounds


def shingle_numbers(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct numbers of its k-word shingles; fewer words make one shingle, none make none."""
    n = len(words) - k + 1
    rolled = mix(sum((words[j : j + n] * _MIX[j] for j in range(k)), np.zeros(max(n, 0), np.uint64))) if n > 0 else words[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            short = mix(np.sum(words[a:b] * _MIX[k : k + b - a], keepdims=True) + np.uint64(b - a))
            yield short
        else:
            yield words[:0]
