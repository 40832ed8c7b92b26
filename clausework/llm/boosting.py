"""Small gradient-boosted trees for binary labels, grown from histograms that may be added over any number of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

BINS = 32
QUANTILES = np.linspace(0, 1, BINS)[1:-1]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: split feature and cut per inner node, value per leaf."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row, inner = np.arange(len(x)), self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Gradients are added as whole multiples of its reciprocal, so that sums do not depend on their order.
SCALE = 1 << 24


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    """Edges of the bins of each feature."""
    return [np.unique(np.quantile(c, QUANTILES)) for c in x.T]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


def histograms(bins: np.ndarray, y: np.ndarray, times: np.ndarray, trees: Trees, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Sums of first and second derivatives under ``trees`` by node of ``level`` of the tree in growth, feature and bin. Rows count ``times``; cuts are bins."""
    p = logistic(trees.margin(bins))
    row, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (bins[row, feature[node]] > cut[node])
    width, wide = 2**level, bins.shape[1]
    key = (((node - width + 1)[:, None] * wide + np.arange(wide)) * BINS + bins).ravel()
    sums = [np.bincount(key, np.repeat(np.rint(d * SCALE) * times, wide), width * wide * BINS) for d in (y - p, p * (1 - p))]
    return np.stack(sums).reshape(2, width, wide, BINS)


def grow(edges: list[np.ndarray], share: float, summed: Callable[..., np.ndarray], rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Newton boosting on the logistic loss with histogram splits; deterministic.

    ``share`` of the rows is positive; ``summed(trees, feature, cut, level)`` gives ``histograms`` added over all rows.
    """
    share = min(max(share, 1e-3), 1 - 1e-3)
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    features, cuts, leaves = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    for _ in range(rounds):
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            g, h = summed(Trees(base, features, cuts, leaves), feature, cut, level).cumsum(axis=-1) / SCALE
            gl, hl, gt, ht = g[..., :-1], h[..., :-1], g[..., -1:], h[..., -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = 0
            for n in range(2**level):
                f, at = np.unravel_index(gain[n].argmax(), gain[n].shape)
                left = (g[n, 0, -1], h[n, 0, -1])
                if gain[n, f, at] > 1e-9:
                    feature[2**level - 1 + n], cut[2**level - 1 + n], left = f, at, (g[n, f, at], h[n, f, at])
                if level == depth - 1:
                    leaf[2 * n] = rate * left[0] / (left[1] + ridge)
                    leaf[2 * n + 1] = rate * (g[n, 0, -1] - left[0]) / (h[n, 0, -1] - left[1] + ridge)
        features, cuts, leaves = np.vstack([features, feature]), np.vstack([cuts, cut]), np.vstack([leaves, leaf])
    values = np.array([[edges[f][int(c)] if np.isfinite(c) else np.inf for f, c in zip(*tree)] for tree in zip(features, cuts)]).reshape(cuts.shape)
    return Trees(base, features, values, leaves)


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees grown on rows at hand."""
    edges = cut_points(x)
    bins = binned(x, edges)
    return grow(edges, float(y.mean()), lambda *tree: histograms(bins, y, np.ones(len(y)), *tree))


def platt(positive: float, negative: float, summed: Callable[[float, float, float, float], np.ndarray], steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities (Platt), by Newton steps.

    ``summed(a, b, high, low)`` adds over all rows, with p the curve's value, d the target (``high`` or ``low``) less p, w = p(1-p)
    and m the margin: d*m, d, w*m*m, w*m and w.
    """
    a, b = 1.0, 0.0
    high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)
    for _ in range(steps):
        dm, d, wmm, wm, w = summed(a, b, high, low)
        hessian = np.array([[wmm, wm], [wm, w]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, [dm, d]), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``platt`` on rows at hand."""

    def summed(a, b, high, low):
        p = logistic(a * margin + b)
        d, w = np.where(y > 0, high, low) - p, p * (1 - p)
        return np.array([(d * margin).sum(), d.sum(), (w * margin**2).sum(), (w * margin).sum(), w.sum()])

    return platt(y.sum(), (1 - y).sum(), summed)
