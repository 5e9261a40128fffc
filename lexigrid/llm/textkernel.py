"""Words, word hashes and shingles of many texts at once, on Arrow's byte buffers.

A word is a maximal run of digits, ASCII letters and non-ASCII characters, with
A-Z in lower case. Texts are taken whole; they are worked on in runs of about a
megabyte so that memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)

_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (the one of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, RUN_BYTES + 4096)
        for k, base in enumerate((_MULT, _INVERSE)):
            steps = np.full(size, _U(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def forget() -> None:
    """Give the tables back; the next text makes them anew."""
    _powers[:] = [np.ones(1, _U), np.ones(1, _U)]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offsets


def runs(offsets: np.ndarray, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about run_bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of texts in order, and each text's number of words."""
    base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    bounds = offsets - base
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    low = _LOWER[values[base : base + n]]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text, and their number by text.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    edges = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    total = int(made.sum())
    if not total:
        return np.zeros(0, _U), made
    heads = np.repeat(edges[:-1] - np.concatenate(([0], np.cumsum(made)))[:-1], made) + np.arange(total)
    padded = np.concatenate((words, np.zeros(size, _U)))
    out = np.zeros(total, _U)
    for k in range(size):
        out = out * _U(_MULT) + padded[heads + k]
    short = np.flatnonzero((counts > 0) & (counts < size))
    at = np.concatenate(([0], np.cumsum(made)))
    for d in short:  # few words each
        value = 0
        for w in words[edges[d] : edges[d + 1]].tolist():
            value = (value * _MULT + w) & 0xFFFFFFFFFFFFFFFF
        out[at[d]] = (value * _MULT + int(counts[d])) & 0xFFFFFFFFFFFFFFFF
    return mix64(out), made
