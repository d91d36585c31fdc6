"""Gradient-boosted trees on histograms, with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in common arrays: a leaf's children are the node itself, so every tree is walked ``depth`` steps."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def constant(p: float) -> Forest:
    """A forest without trees."""
    none = np.zeros(0, dtype=np.int64)
    p = min(max(p, 1e-9), 1 - 1e-9)
    return Forest(none, none, none.astype(float), none, none, none.astype(float), 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Forest:
    """Boosts the logistic loss.  signs: per feature 1 (score may only rise with it), -1 (only fall) or 0.

    A split on a constrained feature whose leaf values would be in the wrong order is not taken, and the mean of the two
    values bounds the values below either side.
    """
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 1.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    f = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, levels: int) -> int:
        k = len(feature)
        leaf = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(rate * leaf)
        if levels == 0 or len(rows) < 2 * least:
            return k
        best, choice = 1e-9, None
        gs, hs, parent = g[rows].sum(), h[rows].sum(), 0.0
        parent = gs * gs / (hs + penalty)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            c = codes[rows, j]
            n = np.bincount(c, minlength=len(cut) + 1).cumsum()[:-1]
            gl = np.bincount(c, g[rows], len(cut) + 1).cumsum()[:-1]
            hl = np.bincount(c, h[rows], len(cut) + 1).cumsum()[:-1]
            a, b = np.clip(-gl / (hl + penalty), low, high), np.clip(-(gs - gl) / (hs - hl + penalty), low, high)
            gain = gl * gl / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - parent
            ok = (n >= least) & (len(rows) - n >= least) & (signs[j] * (b - a) >= 0)
            gain = np.where(ok, gain, -1.0)
            t = int(gain.argmax())
            if gain[t] > best:
                best, choice = gain[t], (j, t, a[t], b[t])
        if choice:
            j, t, a, b = choice
            middle = (a + b) / 2
            side = codes[rows, j] <= t
            bounds = [(low, high), (low, high)] if not signs[j] else [(low, middle), (middle, high)] if signs[j] > 0 else [(middle, high), (low, middle)]
            feature[k], threshold[k], value[k] = j, float(cuts[j][t]), 0.0
            left[k] = grow(rows[side], g, h, *bounds[0], levels - 1)
            right[k] = grow(rows[~side], g, h, *bounds[1], levels - 1)
        return k

    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        first = len(feature)
        roots.append(grow(np.arange(len(y)), q - y, q * (1 - q), -np.inf, np.inf, depth))
        tree = Forest(np.array([first]), *map(np.array, (feature, threshold, left, right, value)), depth, 0.0)
        f += tree.margin(x)
    return Forest(*map(np.array, (roots, feature, threshold, left, right, value)), depth, bias)
