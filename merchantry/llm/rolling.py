"""Polynomial hashes of byte ranges and words over whole Arrow batches, with numpy.

A range's hash does not depend on where it lies: prefix sums of random byte values times powers of an odd
number, modulo 2**64, are divided by the power at the range's begin. Long texts go in slices, so memory
is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from merchantry.llm.common import mix64

#: Bytes that one set of arrays covers.
SLICE = 1 << 20
BASE = 0xD6E8FEB86659FD93
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BLANK = np.zeros(256, np.bool_)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b & 0xFFFFFFFFFFFFFFFF, np.uint64)]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * powers(len(sums))[1][begin]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of each word of a byte array, letters A-Z taken as a-z."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    own = ranges(prefix_sums(LOWER[data]), begin, end)
    return begin, mix64(own + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE bytes; a longer row stands alone."""
    first = 0
    for row in range(1, len(offsets)):
        if offsets[row] - offsets[first] > SLICE and row - 1 > first:
            yield first, row - 1
            first = row - 1
    if first < len(offsets) - 1:
        yield first, len(offsets) - 1


def words_by_row(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in turn) for each row."""
    for first, last in slices(data, offsets):
        own = data[offsets[first]:offsets[last]]
        if len(own) <= 2 * SLICE:
            # A blank between rows keeps words apart.
            at = offsets[first:last + 1] - offsets[first]
            apart = np.insert(own, at[1:-1], 32) if last - first > 1 else own
            begin, hashes = word_hashes(apart)
            cuts = np.searchsorted(begin, at + np.arange(last - first + 1))
            for i in range(last - first):
                yield first + i, hashes[cuts[i]:cuts[i + 1]]
        else:
            yield first, _long_row(own)


def _long_row(data: np.ndarray) -> np.ndarray:
    """Words of a long text, slice by slice, each ending at a blank."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):
            blank = np.flatnonzero(BLANK[data[end:end + SLICE]])
            if len(blank):
                end += blank[0]
                break
            end = min(end + SLICE, len(data))
        out.append(word_hashes(data[at:end])[1])
        at = end
    return np.concatenate(out)
