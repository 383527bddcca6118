"""Gradient-boosted trees with monotonic constraints, held in flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes one after the other; a leaf points to itself on both sides, so rows that have arrived stay."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row, all rows a level at a time."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def _best_split(grad: np.ndarray, hess: np.ndarray, binned: np.ndarray, rows: np.ndarray, n_bins: int, signs: np.ndarray, low: float, high: float, l2: float, min_weight: float):
    """The split with the most gain whose leaf values keep the constraints: (gain, feature, bin, left value, right value)."""
    d = binned.shape[1]
    flat = (binned[rows] + np.arange(d) * n_bins).ravel()
    g = np.bincount(flat, np.repeat(grad[rows], d), d * n_bins).reshape(d, n_bins).cumsum(1)
    h = np.bincount(flat, np.repeat(hess[rows], d), d * n_bins).reshape(d, n_bins).cumsum(1)
    gl, hl = g[:, :-1], h[:, :-1]
    gr, hr = g[:, -1:] - gl, h[:, -1:] - hl
    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
    gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
    gain[(hl < min_weight) | (hr < min_weight) | (signs[:, None] * (vr - vl) < 0)] = -np.inf
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    g_all, h_all = g[0, -1], h[0, -1]
    value = np.clip(-g_all / (h_all + l2), low, high)
    return gain[f, b] + g_all * value + 0.5 * (h_all + l2) * value**2, f, b, vl[f, b], vr[f, b]


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_weight: float = 3.0) -> Forest:
    """Fit log loss by Newton steps on quantile histograms.

    ``signs`` has +1 where a score may only rise with the feature, -1 where it may only fall, else
    0. A split on such a feature must order its leaf values, and the middle of both bounds all
    values below it. One class alone, or no row, gives a constant score.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, int)
    total = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        open_nodes = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, level = open_nodes.pop()
            best = _best_split(grad, hess, binned, rows, bins, signs, low, high, l2, min_weight) if level < depth else (0,)
            if not best[0] > 1e-9:
                total[rows] += nodes[at][4]
                continue
            _, f, b, vl, vr = best
            goes_left = binned[rows, f] <= b
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(signs[f])]
            nodes[at][:4] = [f, float(edges[f][b]), len(nodes), len(nodes) + 1]
            for side, value, (lo, hi) in ((goes_left, vl, bounds[0]), (~goes_left, vr, bounds[1])):
                k = len(nodes)
                nodes.append([0, 0.0, k, k, rate * float(value)])
                open_nodes.append((k, rows[side], lo, hi, level + 1))
    cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(np.array(roots, np.int64), *(np.array(c, k) for c, k in zip(cols, kinds, strict=True)), depth, bias)
