"""Words and five-word shingles of Arrow string columns as 64-bit numbers, in numpy.

A text's words are its runs of bytes other than U+0020 and U+0009..U+000D, with A-Z lowered. Words
and shingles are told apart by 64-bit hashes: two different ones among the n of some comparison
are taken for equal with a chance of n * n / 2**65.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK = 1 << 21  # bytes hashed at once

_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_EACH = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(size + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words in one chunk: sums of byte values times powers."""
    up, down = _powers(max(CHUNK, len(buf)))
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def words(column: pa.Array, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, edges): text i has the words ``edges[i]`` to ``edges[i + 1]``."""
    return marked_words(column, separators, None)[:2]


def marked_words(column: pa.Array, separators: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, and for each word how many bytes of the kind ``marks`` lie before it, in all texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    out, edges, at, end = [], [np.zeros(1, dtype=np.int64)], int(offsets[0]), int(offsets[-1])
    total, passed, before = 0, 0, []
    while at < end:
        stop = min(at + CHUNK, end)
        if stop < end:  # cut between words where possible
            gap = np.flatnonzero(separators[raw[at:stop]])
            inner = offsets[(offsets > at) & (offsets <= stop)]
            stop = max([*inner[-1:], *(gap[-1:] + at + 1)], default=None)
            if stop is None:  # one word longer than a chunk is hashed whole
                after = np.flatnonzero(separators[raw[at + CHUNK : end]])[:1] + at + CHUNK + 1
                stop = min([*after, offsets[offsets > at + CHUNK][0]])
        buf = raw[at:stop]
        inside = ~separators[buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > at) & (offsets < stop)] - at
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(first)
        out.append(_hash(buf, starts, np.flatnonzero(last) + 1))
        if marks is not None:
            seen = np.cumsum(marks[buf], dtype=np.int64)
            before.append(seen[starts] + passed)
            passed += int(seen[-1])
        of = offsets[(offsets > at) & (offsets <= stop)] - at
        edges.append(total + np.searchsorted(starts, of))
        total += len(starts)
        at = int(stop)
    hashes = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    all_edges = np.concatenate(edges)
    lead = int(np.count_nonzero(offsets[1:] == offsets[0]))  # empty texts at the start
    tail = len(offsets) - lead - len(all_edges)
    all_edges = np.concatenate([np.zeros(lead, dtype=np.int64), all_edges, np.full(max(0, tail), total)]).astype(np.int64)
    return hashes, all_edges, np.concatenate(before) if before else np.zeros(0, dtype=np.int64)


def shingles(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles. A text of fewer words has one, of all its words."""
    hashes, edges = words(column)
    n = len(hashes)
    full = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        full += hashes[k : n - WORDS + 1 + k] * _EACH[k] if n >= WORDS else np.zeros(0, dtype=np.uint64)
    full = mix(full)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(full[a : b - WORDS + 1])
        elif b > a:
            yield mix(np.sum(hashes[a:b] * _EACH[: b - a], dtype=np.uint64, keepdims=True) + _EACH[32 + b - a])
        else:
            yield np.zeros(0, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, which bounds what numpy holds at once."""
    for batch in batches:
        for lo in range(0, max(1, len(batch)), rows):
            yield batch.slice(lo, rows)


def release() -> None:
    """Give unused memory of a finished task back, as workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """An Arrow array of lists of 64-bit numbers."""
    edges = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.uint64).view(np.int64)))
