"""A small random forest with calibrated probabilities, trained in numpy on a bounded sample and applied in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Forest:
    edges: list[np.ndarray]  #: thresholds of each feature
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  #: feature, bin, left child, class shares
    classes: np.ndarray
    temperature: float = 1.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:  # one class
            return np.ones((len(x), 1))
        b, rows = self._bin(x), np.arange(len(x))
        total = np.zeros((len(x), len(self.classes)))
        for feature, cut, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                inner = child[at] >= 0
                if not inner.any():
                    break
                step = child[at] + (b[rows, np.maximum(feature[at], 0)] > cut[at])
                at = np.where(inner, step, at)
            total += share[at]
        return total / len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated class probabilities, a row per input."""
        if not len(x):
            return np.zeros((0, len(self.classes)))
        p = (self.raw(x) + 1e-4) ** (1 / self.temperature)
        return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, y: list, trees: int = 24, depth: int = 14, least: int = 2, seed: int = 5) -> Forest | None:
    """Gini trees on bootstrap samples with random feature subsets; a held-out fifth sets the temperature that
    calibrates the averaged shares (least negative log likelihood). None without at least 20 rows; of one
    class there is nothing to learn, it is always predicted."""
    classes, target = np.unique(np.asarray(y, dtype=object).astype(str), return_inverse=True)
    if len(x) < 20:
        return None
    if len(classes) < 2:
        return Forest([], [], classes)
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    forest = Forest(edges, [], classes)
    binned = forest._bin(x)
    held = np.zeros(len(x), bool)
    held[rng.permutation(len(x))[: len(x) // 5]] = True
    base, k, d = np.flatnonzero(~held), len(classes), x.shape[1]
    tried = max(2, int(np.sqrt(d) * 2))
    for _ in range(trees):
        feature, cut, child, share = [], [], [], []

        def leaf(rows: np.ndarray) -> int:
            feature.append(-1), cut.append(0), child.append(-1)
            share.append(np.bincount(target[rows], minlength=k) / max(1, len(rows)))
            return len(feature) - 1

        queue = [(leaf(own := rng.choice(base, len(base))), own, 0)]
        while queue:
            node, rows, level = queue.pop()
            if level == depth or len(rows) < 2 * least or share[node].max() == 1.0:
                continue
            best = (1e-9, -1, 0)
            before = len(rows) * (1 - (share[node] ** 2).sum())
            for j in rng.choice(d, min(d, tried), replace=False):
                hist = np.bincount(binned[rows, j].astype(np.int64) * k + target[rows], minlength=BINS * k).reshape(-1, k)
                left = hist.cumsum(0)[:-1]
                right = hist.sum(0) - left
                nl, nr = left.sum(1), right.sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    impurity = np.where(nl > 0, nl - (left**2).sum(1) / nl, 0) + np.where(nr > 0, nr - (right**2).sum(1) / nr, 0)
                gain = np.where((nl >= least) & (nr >= least), before - impurity, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], j, at)
            if best[1] < 0:
                continue
            high = binned[rows, best[1]] > best[2]
            a, b = leaf(rows[~high]), leaf(rows[high])
            feature[node], cut[node], child[node] = best[1], best[2], a
            queue += [(a, rows[~high], level + 1), (b, rows[high], level + 1)]
        forest.trees.append((np.asarray(feature), np.asarray(cut), np.asarray(child), np.asarray(share)))
    shares, truth = forest.raw(x[held]), target[held]
    forest.temperature = min((0.25, 0.35, 0.5, 0.7, 0.85, 1.0, 1.3, 1.7), key=lambda t: -np.log(((shares + 1e-4) ** (1 / t) / ((shares + 1e-4) ** (1 / t)).sum(1, keepdims=True))[np.arange(len(truth)), truth]).mean())
    return forest
