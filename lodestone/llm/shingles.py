"""Word and shingle hashes of many texts at once, in numpy, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
# An odd base for polynomial hashes modulo 2**64, its inverse, and the multipliers of a well-known 64-bit finaliser.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=_U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words precede each row (one more than there are rows)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[data], out=inside[1:-1])
    start = inside[1:-1] & ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    start[cut] |= inside[1:-1][cut]  # a row's first byte starts a word even if the last row ended in one
    starts = np.flatnonzero(start)
    end = inside[1:-1] & ~inside[2:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    end[last] |= inside[1:-1][last]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_LOWER[data].astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + _U((seed * 2 + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))


def shingles(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` words of each row: the hashes, ascending within a row, and how many precede each row.

    A row of fewer words is one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(before)
    rows = len(counts)
    grams = np.maximum(counts - n + 1, 0)
    if len(hashes) >= n:
        rolled = np.zeros(len(hashes) - n + 1, _U)
        for k in range(n):
            rolled = mix(rolled + hashes[k : len(hashes) - n + 1 + k] + _U(k + 1))
    else:
        rolled = np.zeros(0, _U)
    row = np.repeat(np.arange(rows), grams)
    first = np.cumsum(grams) - grams
    values = rolled[np.arange(len(row)) - first[row] + before[:-1][row]]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        whole = np.zeros(len(few), _U)
        for k in range(n - 1):
            has = counts[few] > k
            whole[has] = mix(whole[has] + hashes[before[few[has]] + k] + _U(k + 1))
        row, values = np.concatenate([row, few]), np.concatenate([values, mix(whole + counts[few].astype(_U) + _U(1 << 32))])
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(row[new], np.arange(rows + 1))
