"""A random forest of classification trees in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees on bootstrap samples, each split chosen by Gini impurity among random features."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 4):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.grown: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        some = max(1, round(x.shape[1] ** 0.5))
        for _ in range(self.trees):
            nodes: list[list[float]] = []  # feature (-1: leaf), limit, left, right, share
            picked = rng.integers(0, len(x), len(x))
            todo = [(picked, 0, -1, 0)]
            while todo:
                rows, level, parent, side = todo.pop()
                here = len(nodes)
                nodes.append([-1, 0, 0, 0, float(y[rows].mean())])
                if parent >= 0:
                    nodes[parent][2 + side] = here
                split = None
                if level < self.depth and 0 < nodes[here][4] < 1:
                    split = self._split(x, y, rows, rng.permutation(x.shape[1]), some)
                if split:
                    feature, limit = split
                    nodes[here][:2] = feature, limit
                    low = x[rows, feature] <= limit
                    todo += [(rows[~low], level + 1, here, 1), (rows[low], level + 1, here, 0)]
            table = np.array(nodes)
            self.grown.append((table[:, 0].astype(int), table[:, 1], table[:, 2:4].astype(int), table[:, 4]))
        return self

    def _split(self, x, y, rows, features, some):
        best, found, tried = np.inf, None, 0
        for f in features:
            order = np.argsort(x[rows, f], kind="stable")
            values, ones = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(rows) + 1)
            cut = np.flatnonzero(values[1:] > values[:-1])
            cut = cut[(cut + 1 >= self.least) & (len(rows) - cut - 1 >= self.least)]
            if len(cut):
                left, right = n[cut], len(rows) - n[cut]
                a, b = ones[cut], ones[-1] - ones[cut]
                impurity = a * (left - a) / left + b * (right - b) / right
                k = int(impurity.argmin())
                if impurity[k] < best:
                    best, found = impurity[k], (int(f), float(values[cut[k]] + values[cut[k] + 1]) / 2)
            tried += 1
            if tried >= some and found:
                break
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, children, share in self.grown:
            at = np.zeros(len(x), int)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                f = feature[at[inner]]
                at[inner] = children[at[inner], (x[inner, f] > limit[at[inner]]).astype(int)]
            total += share[at]
        return total / max(1, len(self.grown))
