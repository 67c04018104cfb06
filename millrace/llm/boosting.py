"""Trees on numeric columns: histogram gradient boosting and a small decision tree.

Trained on a bounded table in numpy; a forest is flattened into arrays so that a whole
batch walks all trees level by level with vector operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Flat nodes of all trees: feature (-1 at leaves), threshold, left child (right is left + 1), value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + go)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner bin borders of each column, at quantiles."""
    q = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, q, method="lower")) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]


def _grow(binned, borders, grad, hess, depth, shrink, l2, min_rows, nodes):
    """Add one tree to ``nodes`` (lists); returns its root and its values on the rows."""
    feature, threshold, left, value = nodes
    bins = max((len(b) for b in borders), default=0) + 1
    n_cols = binned.shape[1]
    offsets = np.arange(n_cols) * bins
    root = len(feature)
    out = np.zeros(len(grad))
    todo = [(root, np.arange(len(grad)), 0)]
    for xs in (feature, threshold, left, value):
        xs.append(0)
    while todo:
        node, rows, level = todo.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        feature[node], threshold[node], left[node], value[node] = -1, 0.0, node, -shrink * g / (h + l2)
        best, pick = 1e-9, None
        if level < depth and len(rows) >= 2 * min_rows:
            flat = (binned[rows] + offsets).ravel()
            size = n_cols * bins
            hg, hh, hn = (np.bincount(flat, np.repeat(w, n_cols), size).reshape(n_cols, bins).cumsum(1)[:, :-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            ok = (hn >= min_rows) & (len(rows) - hn >= min_rows)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, hg**2 / (hh + l2) + (g - hg) ** 2 / (h - hh + l2) - g**2 / (h + l2), -1.0)
            k = int(gain.argmax()) if gain.size else 0
            if gain.size and gain.flat[k] > best:
                pick = divmod(k, bins - 1)
        if pick is None or pick[1] >= len(borders[pick[0]]):
            out[rows] = value[node]
            continue
        f, b = pick
        child = len(feature)
        for xs in (feature, threshold, left, value):
            xs.extend([0, 0])
        feature[node], threshold[node], left[node] = f, borders[f][b], child
        high = binned[rows, f] > b
        todo += [(child, rows[~high], level + 1), (child + 1, rows[high], level + 1)]
    return root, out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, shrink: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 8) -> Forest:
    """Logistic gradient boosting on column histograms; deterministic.

    Without rows, or with one class only, the forest is its base value.
    """
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    nodes: tuple[list, list, list, list] = ([], [], [], [])
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        borders = edges(x, bins)
        binned = np.column_stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T)])
        raw = np.full(len(y), base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            root, out = _grow(binned, borders, prob - y, prob * (1 - prob), depth, shrink, l2, min_rows, nodes)
            roots.append(root)
            raw += out
    f, t, l, v = nodes
    return Forest(np.array(f, np.int64), np.array(t, float), np.array(l, np.int64), np.array(v, float), np.array(roots, np.int64), depth, base)


def decision_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, min_rows: int = 1) -> Forest:
    """One tree by the same split search (squared loss, so Gini gain); raw() is the share of 1."""
    borders = [np.unique(c)[:-1] for c in x.T]
    binned = np.column_stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T)])
    nodes: tuple[list, list, list, list] = ([], [], [], [])
    root, _ = _grow(binned, borders, -y.astype(float), np.ones(len(y)), depth, 1.0, 0.0, min_rows, nodes)
    f, t, l, v = nodes
    return Forest(np.array(f, np.int64), np.array(t, float), np.array(l, np.int64), np.array(v, float), np.array([root]), depth, 0.0)
