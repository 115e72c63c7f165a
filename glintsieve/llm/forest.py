"""A small random forest: grown on the driver from a bounded set of labelled rows, applied as a Spark SQL expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, float, "Tree", "Tree"]  # a share, or feature, threshold, and what holds at most it and over it


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tries: int, least: int) -> Tree:
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return round(share, 6)
    best: tuple[float, int, float] | None = None
    for feature in rng.choice(x.shape[1], size=min(tries, x.shape[1]), replace=False):
        order = np.argsort(x[:, feature], kind="stable")
        values, ones = x[order, feature], np.cumsum(y[order])
        left = np.arange(1, len(y))
        cut = np.flatnonzero((values[1:] > values[:-1]) & (left >= least) & (len(y) - left >= least))
        if not len(cut):
            continue
        n, a = left[cut], ones[:-1][cut]
        p, q = a / n, (ones[-1] - a) / (len(y) - n)
        impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0]:
            best = (float(impurity[k]), int(feature), float((values[cut[k]] + values[cut[k] + 1]) / 2))
    if best is None:
        return round(share, 6)
    _, feature, threshold = best
    low = x[:, feature] <= threshold
    return (feature, threshold, _grow(x[low], y[low], rng, depth - 1, tries, least), _grow(x[~low], y[~low], rng, depth - 1, tries, least))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 7, least: int = 2, seed: int = 11) -> list[Tree]:
    """Trees on bootstrap samples, each split over a random share of the features."""
    rng = np.random.default_rng(seed)
    tries = max(1, round(x.shape[1] ** 0.5) + 1)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows].astype(float), rng, depth, tries, least))
    return out


def value(tree: Tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def predict(trees: list[Tree], row: np.ndarray) -> float:
    """Mean share of the trees, on the driver: for tests."""
    return sum(value(t, row) for t in trees) / len(trees)


def column(tree: Tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, low, high = tree
    return F.when(features[feature] <= F.lit(threshold), column(low, features)).otherwise(column(high, features))


def score(trees: list[Tree], features: list[Column]) -> Column:
    """Mean share of the trees as an expression."""
    total = column(trees[0], features)
    for tree in trees[1:]:
        total = total + column(tree, features)
    return total / F.lit(float(len(trees)))
