"""Hashes of all substrings of many strings at once, and lookups of such hashes in a fixed set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4096, _BASE)]), dtype=np.uint64)


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in `strings`, prefix hashes) for each length that occurs, the empty one aside.

    Row r, column j of the prefix hashes is the hash of the first j characters of string r.
    """
    if not strings:
        return
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    order = np.argsort(lengths, kind="stable")
    starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for at, to in zip(starts, [*starts[1:], len(order)], strict=True):
        rows, n = order[at:to], int(lengths[order[at]])
        if not n:
            continue
        codes = np.frombuffer("".join([strings[r] for r in rows]).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(rows), n)
        prefix = np.zeros((len(rows), n + 1), dtype=np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        yield rows, prefix


def span(prefix: np.ndarray, i: int, j: int) -> np.ndarray:
    """Hashes of characters i to j of every row."""
    return prefix[:, j] - prefix[:, i] * _POWERS[j - i]


def hashes(strings: list[str]) -> np.ndarray:
    """The hash of each whole string."""
    out = np.zeros(len(strings), dtype=np.uint64)
    for rows, prefix in by_length(strings):
        out[rows] = prefix[:, -1]
    return out


class Lookup:
    """Positions in a fixed array of distinct hashes; a bit table turns most misses away early."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.bits = np.zeros(1 << 18, dtype=bool)
        self.bits[self.keys >> np.uint64(46)] = True

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of `wanted` that are keys, their positions)."""
        rows = np.flatnonzero(self.bits[wanted >> np.uint64(46)])
        if not len(rows) or not len(self.keys):
            return rows[:0], rows[:0]
        at = np.minimum(np.searchsorted(self.keys, wanted[rows]), len(self.keys) - 1)
        hit = self.keys[at] == wanted[rows]
        return rows[hit], self.order[at[hit]]
