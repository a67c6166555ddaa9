"""Rolling hashes and winnowing over byte strings, vectorised with numpy.

A text is hashed once into prefix sums; the hash of any slice is then one subtraction and one multiplication.  All
arithmetic is modulo 2**64: every byte maps to a fixed pseudo-random word, position i is weighted with BASE**i,
and a slice is brought back to position zero with the inverse power.  Equal slices always have equal hashes.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept per process up to the longest text seen."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        grown = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            grown.append(np.multiply.accumulate(table))
        if size > 1 << 22:  # a rare giant text must not hold memory for the life of the worker
            return grown[0], grown[1]
        _powers = (grown[0], grown[1])
    return _powers


class Prefix:
    """Prefix hashes of a string of bytes, or of items that are hashes already: many slices are hashed at once."""

    def __init__(self, data: bytes | np.ndarray):
        items = _BYTES[np.frombuffer(data, np.uint8)] if isinstance(data, bytes) else data
        up, self._down = _power_tables(len(items) + 1)
        sums = np.empty(len(items) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(items * up[: len(items)], out=sums[1:])
        self._sums = sums

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        body = (self._sums[end] - self._sums[start]) * self._down[start]
        return _mix(body + (end - start).astype(np.uint64))

    def sliding(self, size: int) -> np.ndarray:
        """Hashes of all slices of one size, in order."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self._sums[size:] - self._sums[:n]) * self._down[:n] + np.uint64(size))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` consecutive values, the index of its smallest value (the last one among equals).

    The choice depends on the values of that run alone, so equal runs in different texts choose the same offset.
    """
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    best, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < window:  # widths double; the last step overlaps, which does no harm to a minimum
        step = min(width, window - width)
        later = best[step:] <= best[:-step]
        best = np.where(later, best[step:], best[:-step])
        at = np.where(later, at[step:], at[:-step])
        width += step
    return at


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each stretch of equal neighbours."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return start, np.diff(np.r_[start, len(at)])
