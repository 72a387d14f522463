"""Boosted trees over small binned features, fitted on a counted table, applied as a Column."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    """A split of feature ``f`` at ``<= at``, or a leaf with ``value``."""

    f: int = -1
    at: int = 0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.f < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.f] <= self.at, self.low.apply(x), self.high.apply(x))

    def column(self, features: list[Column]) -> Column:
        if self.f < 0:
            return F.lit(self.value)
        return F.when(features[self.f] <= self.at, self.low.column(features)).otherwise(self.high.column(features))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, ridge: float) -> Tree:
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
    every = np.ones(len(x), bool)
    best = (1e-6 + score(every), -1, 0)
    if depth:
        for f in range(x.shape[1]):
            for at in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= at
                best = max(best, (score(low) + score(~low), f, int(at)))
    if best[1] < 0:
        return Tree(value=float(rate * g.sum() / (h.sum() + ridge)))
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], _grow(x[low], g[low], h[low], depth - 1, rate, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, rate, ridge))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, ridge: float = 1.0) -> list[Tree]:
    """Trees whose summed values are log odds of ``y``; each fits the gradient of the log loss."""
    odds, found = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        found.append(_grow(x, weight * (y - p), weight * p * (1 - p), depth, rate, ridge))
        odds += found[-1].apply(x)
    return found


def log_odds(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((t.apply(x) for t in trees), np.zeros(len(x)))


def log_odds_column(trees: list[Tree], features: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + t.column(features)
    return total


def calibrated(odds: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The lowest cut whose selection has at least ``precision``; none selected if there is none."""
    for cut in np.unique(odds):
        chosen = odds >= cut
        if (weight * y)[chosen].sum() >= precision * weight[chosen].sum():
            return float(cut) - 1e-9
    return math.inf
