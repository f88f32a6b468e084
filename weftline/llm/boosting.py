"""Gradient-boosted trees, small enough to fit on the driver and to score as a column expression inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A split (feature, threshold, low, high) or, without children, a value."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


@dataclass
class Boosted:
    """An additive model of log-odds."""

    names: list[str]
    bias: float
    trees: list[Node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.bias)
        for t in self.trees:
            out += _predict(t, x)
        return out

    def column(self) -> Column:
        """Log-odds as a column expression over columns of the features' names."""

        def walk(n: Node) -> Column:
            if n.low is None or n.high is None:
                return F.lit(float(n.value))
            return F.when(F.col(self.names[n.feature]) <= F.lit(float(n.threshold)), walk(n.low)).otherwise(walk(n.high))

        out = F.lit(float(self.bias))
        for t in self.trees:
            out = out + walk(t)
        return out


def _predict(n: Node, x: np.ndarray) -> np.ndarray:
    if n.low is None or n.high is None:
        return np.full(len(x), n.value)
    go = x[:, n.feature] <= n.threshold
    return np.where(go, _predict(n.low, x), _predict(n.high, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, cuts: list[np.ndarray], least: int, ridge: float) -> Node:
    value = -g.sum() / (h.sum() + ridge)
    if depth == 0 or len(g) < 2 * least:
        return Node(value)
    best, choice = 1e-6, None
    base = g.sum() ** 2 / (h.sum() + ridge)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        place = np.searchsorted(c, x[:, f], side="left")
        gs, hs, ns = (np.cumsum(np.bincount(place, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h, np.ones(len(g))))
        ok = (ns >= least) & (len(g) - ns >= least)
        gain = np.where(ok, gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - base, -1.0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, choice = gain[k], (f, float(c[k]))
    if choice is None:
        return Node(value)
    f, t = choice
    go = x[:, f] <= t
    return Node(value, f, t, _grow(x[go], g[go], h[go], depth - 1, cuts, least, ridge), _grow(x[~go], g[~go], h[~go], depth - 1, cuts, least, ridge))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> Boosted:
    """Boosts logistic loss; with one class only the model is that class's log-odds."""
    x, y = np.asarray(x, dtype=float).reshape(len(y), len(names)), np.asarray(y, dtype=float)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Boosted(list(names), float(np.log(share / (1 - share))), [])
    if not len(y) or y.min() == y.max():
        return model
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        v = v if len(v) <= 64 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 64)))
        cuts.append((v[1:] + v[:-1]) / 2)
    f = np.full(len(y), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = _grow(x, p - y, p * (1 - p), depth, cuts, least, ridge)
        _scale(tree, rate)
        model.trees.append(tree)
        f += _predict(tree, x)
    return model


def _scale(n: Node, rate: float) -> None:
    n.value *= rate
    if n.low is not None and n.high is not None:
        _scale(n.low, rate)
        _scale(n.high, rate)
