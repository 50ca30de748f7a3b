"""Small boosted trees over a histogram of feature vectors, and their form as a column expression."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, threshold, left, right) with left for values up to the threshold, or a leaf's value.
Tree = tuple | float


def _leaf(g: np.ndarray, h: np.ndarray, shrink: float, l2: float) -> float:
    return float(-shrink * g.sum() / (h.sum() + l2))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, shrink: float, l2: float) -> Tree:
    best, where = 1e-9, None
    gain = lambda gs, hs: gs * gs / (hs + l2)
    whole = gain(g.sum(), h.sum())
    for f in range(x.shape[1] if depth else 0):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            got = gain(g[low].sum(), h[low].sum()) + gain(g[~low].sum(), h[~low].sum()) - whole
            if got > best:
                best, where = got, (f, int(t))
    if where is None:
        return _leaf(g, h, shrink, l2)
    f, t = where
    low = x[:, f] <= t
    return (f, t, _grow(x[low], g[low], h[low], depth - 1, shrink, l2), _grow(x[~low], g[~low], h[~low], depth - 1, shrink, l2))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _apply(a, x), _apply(b, x))


def fit(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 40, depth: int = 3, shrink: float = 0.3, l2: float = 1.0) -> list[Tree]:
    """Trees for the log odds, by Newton boosting of the logistic loss.

    x: one row for each distinct integer feature vector; positive, negative: how many candidates of each class have it.
    """
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        n = positive + negative
        trees.append(_grow(x, p * n - positive, p * (1 - p) * n, depth, shrink, l2))
        score = score + _apply(trees[-1], x)
    return trees


def probability(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-sum((_apply(t, x) for t in trees), np.zeros(len(x)))))


def probability_of(trees: list[Tree], features: list[Column]) -> Column:
    """The same as a column."""

    def column(t: Tree) -> Column:
        if isinstance(t, float):
            return F.lit(t)
        return F.when(features[t[0]] <= t[1], column(t[2])).otherwise(column(t[3]))

    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, map(column, trees), F.lit(0.0))))
