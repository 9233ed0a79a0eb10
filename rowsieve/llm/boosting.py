"""Gradient-boosted trees with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2.

    ``feature`` and ``cut`` hold the inner nodes of each tree, ``leaf`` its leaves. A row
    goes right where its feature exceeds the cut.
    """

    depth: int
    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        n, inner = len(rows), 2**self.depth - 1
        total = np.full(n, self.base)
        at_row = np.arange(n)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[at_row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    monotonic: list[int],
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    penalty: float = 2.0,
    least: int = 20,
) -> Forest:
    """Boost ``trees`` trees on logistic loss.

    ``monotonic[f]`` is 1 or -1 where the score may only rise or only fall with feature
    f: a split that breaks it is not taken, and both sides stay within the middle of the
    two values, so that no deeper split can break it either.
    """
    count, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(width)], axis=1)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(count, base)
    inner = 2**depth - 1
    made = []
    for _ in range(trees):
        chance = 1.0 / (1.0 + np.exp(-total))
        slope, curve = labels - chance, chance * (1 - chance)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        leaf = np.zeros(inner + 1)
        node = np.zeros(count, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = bounds[k]
            here = np.flatnonzero(node == k)
            best = _best_split(codes[here], slope[here], curve[here], cuts, monotonic, penalty, least, low, high)
            middle = None
            if best:
                f, bin_, middle = best
                feature[k], cut[k] = f, cuts[f][bin_]
                right = codes[here, f] > bin_
            else:
                right = np.zeros(len(here), bool)
            node[here] = 2 * k + 1 + right
            kind = monotonic[feature[k]] if best else 0
            bounds[2 * k + 1] = (low, middle) if kind > 0 else (middle, high) if kind < 0 else (low, high)
            bounds[2 * k + 2] = (middle, high) if kind > 0 else (low, middle) if kind < 0 else (low, high)
        for k in range(inner, 2 * inner + 1):
            here = node == k
            value = slope[here].sum() / (curve[here].sum() + penalty)
            leaf[k - inner] = rate * float(np.clip(value, *bounds[k]))
        total += leaf[node - inner]
        made.append((feature, cut, leaf))
    feature, cut, leaf = (np.stack(x) for x in zip(*made, strict=True))
    return Forest(depth, base, feature, cut, leaf)


def _best_split(codes, slope, curve, cuts, monotonic, penalty, least, low, high):
    """(feature, bin, middle value) of the split with the largest gain, or None."""
    best, found = 1e-6, None
    slopes, curves = slope.sum(), curve.sum()
    whole = slopes**2 / (curves + penalty)
    for f, kind in enumerate(monotonic):
        size = len(cuts[f]) + 1
        if size < 2:
            continue
        s = np.cumsum(np.bincount(codes[:, f], slope, size))[:-1]
        c = np.cumsum(np.bincount(codes[:, f], curve, size))[:-1]
        n = np.cumsum(np.bincount(codes[:, f], minlength=size))[:-1]
        left = np.clip(s / (c + penalty), low, high)
        right = np.clip((slopes - s) / (curves - c + penalty), low, high)
        gain = s**2 / (c + penalty) + (slopes - s) ** 2 / (curves - c + penalty) - whole
        fits = (n >= least) & (len(codes) - n >= least) & (kind * (right - left) >= 0)
        if fits.any():
            k = int(np.argmax(np.where(fits, gain, -np.inf)))
            if gain[k] > best:
                best, found = gain[k], (f, k, float(left[k] + right[k]) / 2)
    return found
