"""Boosted trees for one series: squared error, level by level, over quantile bins.

A series' rows are bounded by its span of time, so each is fitted in one task; Spark spreads series,
folds and what is tuned. For one model over rows that no task can hold, see models.fit_gbm_pooled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
LEAST_ROWS = 20


@dataclass
class Trees:
    """base + the sum of value[t, leaf]; a complete tree's nodes stand level by level in feature and cut."""

    edges: list[np.ndarray]
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def predict(self, x: np.ndarray, rounds: int | None = None) -> np.ndarray:
        """Predictions by the first `rounds` trees."""
        codes, rows = self.codes(x), np.arange(len(x))
        inner = self.feature.shape[1]
        out = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature[:rounds], self.cut[:rounds], self.value[:rounds], strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rate: float, rounds: int, depth: int = 5, least: int = LEAST_ROWS, bins: int = BINS) -> Trees:
    """`rounds` trees of that depth, each on what the ones before leave over. A leaf has `least` rows at least."""
    n, p = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(p)]
    inner, leaves = 2**depth - 1, 2**depth
    trees = Trees(edges, float(y.mean()), np.zeros((rounds, inner), dtype=np.int64), np.full((rounds, inner), 255, dtype=np.uint8), np.zeros((rounds, leaves)))
    codes = trees.codes(x)
    place = (codes + np.arange(p) * bins).astype(np.int64)
    left_over = y - trees.base
    for t in range(rounds):
        node = np.zeros(n, dtype=np.int64)  # within its level
        for level in range(depth):
            width = 2**level
            at = (node[:, None] * (p * bins) + place).ravel()
            size = np.bincount(at, minlength=width * p * bins).reshape(width, p, bins).cumsum(axis=2)
            total = np.bincount(at, weights=np.repeat(left_over, p), minlength=width * p * bins).reshape(width, p, bins).cumsum(axis=2)
            all_size, all_total = size[:, :1, -1:], total[:, :1, -1:]
            right = all_size - size
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = total**2 / size + (all_total - total) ** 2 / right - all_total**2 / all_size
            gain = np.where((size >= least) & (right >= least), gain, 0.0).reshape(width, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(width), best] > 1e-12
            first = width - 1
            trees.feature[t, first : first + width] = np.where(split, best // bins, 0)
            trees.cut[t, first : first + width] = np.where(split, best % bins, 255)  # 255: all rows go left
            node = 2 * node + (codes[np.arange(n), trees.feature[t, first + node]] > trees.cut[t, first + node])
        size = np.bincount(node, minlength=leaves)
        trees.value[t] = rate * np.bincount(node, weights=left_over, minlength=leaves) / np.maximum(size, 1)
        left_over = left_over - trees.value[t][node]
    return trees


def tune_and_fit(x: np.ndarray, y: np.ndarray, validation: np.ndarray, grid: tuple[tuple[float, int], ...], depth: int) -> tuple[tuple[float, int], Trees]:
    """The (rate, rounds) with the lowest error on the validation rows, the first of equals, and its trees on all rows.

    The first trees of a longer fit are those of a shorter one, so each rate is fitted once.
    """
    losses: dict[tuple[float, int], float] = {}
    for rate in dict.fromkeys(rate for rate, _ in grid):
        mine = [rounds for r, rounds in grid if r == rate]
        trees = fit_trees(x[~validation], y[~validation], rate, max(mine), depth)
        for rounds in mine:
            losses[rate, rounds] = float(np.abs(trees.predict(x[validation], rounds) - y[validation]).mean())
    best = min(grid, key=lambda c: losses[c])
    return best, fit_trees(x, y, *best, depth)
