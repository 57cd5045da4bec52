"""Gradient-boosted trees for a bounded table of numeric features (logistic loss, histogram splits)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.2


@dataclass
class Boosted:
    """Complete binary trees: feature and cut of each inner node, value of each leaf."""

    bias: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, ridge: float = 1.0) -> Boosted:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        model = cls(bias=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
        score = np.full(len(y), model.bias)
        inner = 2**DEPTH - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for at in range(inner):
                own = np.flatnonzero(node == at)
                best = 1e-6
                g, h = gradient[own].sum(), hessian[own].sum()
                for f, e in enumerate(edges if len(own) > 1 else []):
                    if not len(e):
                        continue
                    left_g = np.cumsum(np.bincount(binned[own, f], weights=gradient[own], minlength=len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[own, f], weights=hessian[own], minlength=len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[at], cut[at] = gain[k], f, e[k]
                node[own] = 2 * at + 1 + (x[own, feature[at]] > cut[at])
            own_leaf = node - inner
            leaf = RATE * np.bincount(own_leaf, weights=gradient, minlength=inner + 1) / (np.bincount(own_leaf, weights=hessian, minlength=inner + 1) + ridge)
            score += leaf[own_leaf]
            model.trees.append((feature, cut, leaf))
        return model
