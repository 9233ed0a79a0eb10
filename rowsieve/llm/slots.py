"""A minimal perfect hash over 128-bit digests, in flat arrays."""

from __future__ import annotations

import numpy as np

_GROW = 1.6
_LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of one row of each digest."""
    order = np.lexsort((high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return order[new]


class Slots:
    """Slots 0 to n - 1 for n distinct digests (two arrays of unsigned 64-bit numbers).

    Level by level, digests that have a place of a bitmap to themselves take it, and the
    others go on; a digest's slot is the rank of its bit. Each slot holds its digest, so a
    digest that was not entered is told, never taken for another.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self._levels: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(low))
        taken = 0
        while len(left):
            if len(self._levels) == _LEVELS:
                raise ValueError("digests are not distinct")
            size = max(64, int(len(left) * _GROW))
            place = self._place(low[left], high[left], len(self._levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = taken + np.cumsum(alone) - 1
            self._levels.append((alone, rank))
            taken = int(rank[-1]) + 1
            left = left[~alone[place]]
        self.low = np.empty(len(low), np.uint64)
        self.high = np.empty(len(low), np.uint64)
        found = self._find(low, high)
        self.low[found], self.high[found] = low, high

    @staticmethod
    def _place(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            turned = mix(high + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        return (mix(low ^ turned) % np.uint64(size)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.full(len(low), -1)
        left = np.arange(len(low))
        for level, (alone, rank) in enumerate(self._levels):
            place = self._place(low[left], high[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each digest; all must have been entered, and their full digests are compared."""
        found = self._find(low, high)
        if (found < 0).any() or (self.low[found] != low).any() or (self.high[found] != high).any():
            raise KeyError("a digest has no slot")
        return found
