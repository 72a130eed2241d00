"""Vectorised hashing of the words of many texts, straight from Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
    return out


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lowered, first word of each text and the end).

    Words are runs of bytes other than ``separators`` (ASCII white space); none crosses texts.
    """
    inside = ~separators[data]
    before = np.concatenate([[False], inside[:-1]]) if data.size else inside
    before[offsets[:-1][offsets[:-1] < data.size]] = False
    starts = np.flatnonzero(inside & ~before)
    firsts = np.searchsorted(starts, offsets)
    if not starts.size:
        return np.zeros(0, np.uint64), firsts
    at = np.flatnonzero(inside)
    first_of = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first_of, at.size))
    place = np.arange(at.size) - np.repeat(first_of, lengths)
    value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix64(np.add.reduceat(value, first_of) + lengths.astype(np.uint64)), firsts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; fewer words count as one run; none give none."""
    if not words.size:
        return words
    n = max(1, words.size - size + 1)
    code = np.full(n, min(size, words.size), np.uint64)
    for j in range(min(size, words.size)):
        code = code * _BASE + words[j : j + n]
    return np.unique(mix64(code))
