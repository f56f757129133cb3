"""Small gradient-boosted trees: fitted in numpy on counted rows, scored as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    most: float
    low: "Split | float"
    high: "Split | float"


def fit(
    x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, *, trees: int = 20, depth: int = 2, rate: float = 0.4
) -> list[Split | float]:
    """Trees whose summed values are log odds; x: rows by features, y: 0 or 1, n: how often each row occurs."""
    n = np.ones(len(y)) if n is None else n
    model: list[Split | float] = []
    score = np.zeros(len(y))
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        tree = _grow(x, n * (y - chance), n * chance * (1 - chance), n, depth, rate)
        model.append(tree)
        score += _values(tree, x)
    return model


def _quantiles(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values at 16 equal steps through all rows, each counted n times."""
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    places = np.floor(np.linspace(0, 1, 17)[:-1] * (upto[-1] - 1))
    return np.unique(x[order][np.searchsorted(upto, places, side="right")])


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, n: np.ndarray, depth: int, rate: float) -> Split | float:
    leaf = float(rate * slope.sum() / (curve.sum() + 1.0))
    if depth == 0 or n.sum() < 8:
        return leaf
    gain = lambda g, h: g * g / (h + 1.0)
    whole, best = gain(slope.sum(), curve.sum()), (1e-6, -1, 0.0)
    for feature in range(x.shape[1]):
        for most in _quantiles(x[:, feature], n):
            low = x[:, feature] <= most
            if low.all():
                continue
            better = gain(slope[low].sum(), curve[low].sum()) + gain(slope[~low].sum(), curve[~low].sum()) - whole
            if better > best[0]:
                best = (better, feature, float(most))
    _, feature, most = best
    if feature < 0:
        return leaf
    low = x[:, feature] <= most
    return Split(
        feature,
        most,
        _grow(x[low], slope[low], curve[low], n[low], depth - 1, rate),
        _grow(x[~low], slope[~low], curve[~low], n[~low], depth - 1, rate),
    )


def _values(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.most, _values(tree.low, x), _values(tree.high, x))


def scores(model: list[Split | float], x: np.ndarray) -> np.ndarray:
    return sum((_values(tree, x) for tree in model), np.zeros(len(x)))


def score_column(model: list[Split | float], feature: Callable[[int], Column]) -> Column:
    """The same sum as a Column."""

    def column(tree: Split | float) -> Column:
        if not isinstance(tree, Split):
            return F.lit(tree)
        return F.when(feature(tree.feature) <= F.lit(tree.most), column(tree.low)).otherwise(column(tree.high))

    return sum((column(tree) for tree in model), F.lit(0.0))


def threshold(score: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The least held-out score from which on at least this share is positive; infinite if none."""
    n = np.ones(len(y)) if n is None else n
    if not len(y):
        return float("inf")
    order = np.argsort(-score, kind="stable")
    share = np.cumsum((n * y)[order]) / np.cumsum(n[order])
    last = np.r_[score[order][1:] != score[order][:-1], True]  # equal scores stand or fall together
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")
