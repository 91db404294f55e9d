"""Gradient-boosted trees for a few classes on a bounded, in-memory training set (multinomial loss, binned features)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Tree:
    """A complete binary tree of fixed depth: split feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.value).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


class BoostedTrees:
    """fit(x, y) with classes 0..k-1. Deterministic: rows are not sampled, and every step-th feature goes to a tree, another one first each time."""

    def __init__(self, classes: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, step: int = 1):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge, self.step = classes, rounds, depth, rate, bins, ridge, step
        self.trees: list[list[Tree]] = []
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.asarray(x, dtype=np.float64)
        cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        onehot = np.eye(self.classes)[y]
        prior = np.log(np.maximum(onehot.mean(axis=0), 1e-6))
        self.prior = prior
        scores = np.tile(prior, (len(x), 1))
        for turn in range(self.rounds):
            p = softmax(scores)
            layer = []
            for k in range(self.classes):
                tree, leaf = self._grow(binned, cuts, range((turn + k) % self.step, len(cuts), self.step), p[:, k] - onehot[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-9))
                layer.append(tree)
                scores[:, k] += tree.value[leaf]
            self.trees.append(layer)
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], used: range, g: np.ndarray, h: np.ndarray) -> tuple[Tree, np.ndarray]:
        n, f = len(binned), len(used)
        width = self.bins + 1
        base = binned[:, used.start :: used.step] + np.arange(f) * width
        weights = [np.repeat(w, f) for w in (g, h)]
        inner = (1 << self.depth) - 1
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            place = (base + ((node - first) * f * width)[:, None]).ravel()
            shape = (count, f, width)
            hist = [np.bincount(place, weights=w, minlength=count * f * width).reshape(shape).cumsum(axis=2) for w in weights]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
            for i in range(count):
                best = int(np.argmax(np.where(gain[i] > 1e-9, gain[i], 0)))
                of, b = divmod(best, width)
                j = used[of]
                if gain[i, of, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            cut_bin = np.array([np.searchsorted(cuts[j], t) if np.isfinite(t) else width for j, t in zip(feature, threshold, strict=True)])
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_bin[node])
        leaf = node - inner
        leaves = 1 << self.depth
        gs, hs = np.bincount(leaf, weights=g, minlength=leaves), np.bincount(leaf, weights=h, minlength=leaves)
        return Tree(feature, threshold, -self.rate * gs / (hs + self.ridge)), leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        out = np.tile(self.prior, (len(x), 1))
        for layer in self.trees:
            for k, tree in enumerate(layer):
                out[:, k] += tree.predict(x)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Sets the temperature by which the scores of held-out rows give the least log loss."""
        scores = self.scores(x)
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.scores(x) / self.temperature)
