"""Gradient-boosted regression trees on the logistic loss, small and in numpy."""

from __future__ import annotations

import numpy as np


class Tree:
    """Binary tree in arrays; a row goes left if feature <= threshold; leaves have feature -1."""

    def __init__(self) -> None:
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def add(self, value: float) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        return len(self.value) - 1

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conjunctions (feature, at most?, threshold) that lead to each node below the root."""
        out, todo = [], [(0, ())]
        while todo:
            i, path = todo.pop()
            if path:
                out.append(path)
            if self.feature[i] >= 0:
                todo.append((self.left[i], (*path, (self.feature[i], True, self.threshold[i]))))
                todo.append((self.right[i], (*path, (self.feature[i], False, self.threshold[i]))))
        return out


def _grow(tree: Tree, x: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float) -> int:
    gs, hs = g[rows].sum(), h[rows].sum()
    node = tree.add(float(-gs / (hs + ridge)))
    if depth == 0 or len(rows) < 2 * least:
        return node
    best = (1e-6, -1, -1)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        b = x[rows, f]
        gb, hb = np.bincount(b, g[rows], minlength=len(cut) + 1), np.bincount(b, h[rows], minlength=len(cut) + 1)
        nb = np.bincount(b, minlength=len(cut) + 1)
        gl, hl, nl = np.cumsum(gb)[:-1], np.cumsum(hb)[:-1], np.cumsum(nb)[:-1]
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(nl < least) | (len(rows) - nl < least)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return node
    _, f, k = best
    go = x[rows, f] <= k
    tree.feature[node], tree.threshold[node] = f, float(cuts[f][k])
    tree.left[node] = _grow(tree, x, cuts, rows[go], g, h, depth - 1, least, ridge)
    tree.right[node] = _grow(tree, x, cuts, rows[~go], g, h, depth - 1, least, ridge)
    return node


class Boosted:
    """An additive model of trees; ``raw`` gives log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8, bins: int = 48, ridge: float = 1.0):
        mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        if not len(y):
            return
        cuts = []
        for f in range(x.shape[1]):
            q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
            cuts.append(q[q < x[:, f].max()])
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        z = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            tree = Tree()
            _grow(tree, binned, cuts, np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), depth, least, ridge)
            tree.value = [rate * v for v in tree.value]
            self.trees.append(tree)
            z = z + self._one(tree, x)
        self.depth = depth

    @staticmethod
    def _one(tree: Tree, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(tree.feature), np.array(tree.threshold)
        left, right = np.array(tree.left), np.array(tree.right)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return np.array(tree.value)[at]
            go = x[rows, np.maximum(f, 0)] <= threshold[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self._one(t, x)
        return z
