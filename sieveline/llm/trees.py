"""Gradient-boosted trees and isotonic calibration on numpy arrays.

The models here are fitted on bounded samples of labelled rows and then applied inside Arrow batches, so they need no
cluster: histograms of at most 32 bins per feature, depth-wise trees, logistic loss.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..plans.scale import frames


class Boosted:
    """Binary gradient boosting: ``fit`` on (rows, features), ``margin`` and ``predict`` on any number of rows."""

    def __init__(self, trees: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 32, leaf: float = 3.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.ridge = trees, depth, rate, bins, leaf, ridge
        self.base, self.nodes = 0.0, []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if x.shape[1] else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, start: np.ndarray | None = None) -> Boosted:
        """``start``: margins to begin with; give the same kind to ``margin``."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.nodes = []
        if not len(y):
            self.base = 0.0
            return self
        p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p))) if start is None else 0.0
        if y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        k, f = self.bins + 1, x.shape[1]
        flat = b + np.arange(f) * k
        margin = np.full(len(y), self.base) if start is None else np.asarray(start, float).copy()
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-6)
            at, tree = np.zeros(len(y), int), {}
            open_nodes, free = [0], 1
            for _ in range(self.depth):
                nxt = []
                for node in open_nodes:
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 2:
                        continue
                    idx = flat[rows].ravel()
                    gs = np.bincount(idx, np.repeat(g[rows], f), f * k).reshape(f, k).cumsum(1)[:, :-1]
                    hs = np.bincount(idx, np.repeat(h[rows], f), f * k).reshape(f, k).cumsum(1)[:, :-1]
                    ns = np.bincount(idx, np.repeat(w[rows], f), f * k).reshape(f, k).cumsum(1)[:, :-1]
                    gt, ht, nt = g[rows].sum(), h[rows].sum(), w[rows].sum()
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(ns < self.leaf) | (nt - ns < self.leaf)] = -1
                    j, t = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, t] <= 1e-6:
                        continue
                    left, right, free = free, free + 1, free + 2
                    tree[node] = (int(j), int(t), left, right)
                    go = b[rows, j] <= t
                    at[rows] = np.where(go, left, right)
                    nxt += [left, right]
                open_nodes = nxt
            value = np.zeros(free)
            sums, hess = np.bincount(at, g, free), np.bincount(at, h, free)
            value[: len(sums)] = self.rate * sums / (hess + self.ridge)
            margin += value[at]
            table = np.zeros((free, 4), int)
            table[:, 2] = table[:, 3] = np.arange(free)
            for node, split in tree.items():
                table[node] = split
            self.nodes.append((table, value))
        return self

    def margin(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        x = np.asarray(x, float)
        out = np.full(len(x), self.base) if start is None else np.asarray(start, float).copy()
        if not self.nodes or not len(x):
            return out
        # One row of small integers per feature: a node is one comparison of such a row, a tree a nest of choices.
        b = [np.searchsorted(e, x[:, k], "left").astype(np.uint8) for k, e in enumerate(self.edges)]

        def value(table: np.ndarray, leaves: np.ndarray, node: int):
            j, t, left, right = table[node]
            if left == node:
                return leaves[node]
            return np.where(b[j] <= t, value(table, leaves, left), value(table, leaves, right))

        for table, leaves in self.nodes:
            out += value(table, leaves.astype(np.float32), 0)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, for models fitted without ``start``."""
        return 1 / (1 + np.exp(-self.margin(x)))


class Isotonic:
    """Calibration: pool-adjacent-violators on (score, label), linear between the pooled points."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(np.asarray(score, float)[order], np.asarray(y, float)[order]):
            blocks.append([v, 1.0, s, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v2, n2, _, hi = blocks.pop()
                v1, n1, lo, _ = blocks.pop()
                blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, lo, hi])
        self.x = np.array([p for b in blocks for p in (b[2], b[3])])
        self.y = np.array([p for b in blocks for p in (b[0], b[0])])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.asarray(score, float)


def held_out(x: np.ndarray, y: np.ndarray, folds: np.ndarray, weight: np.ndarray | None = None, **params) -> np.ndarray:
    """Predictions for each row by a model fitted on the other folds."""
    out = np.zeros(len(y))
    for k in np.unique(folds):
        test = folds == k
        w = None if weight is None else weight[~test]
        out[test] = Boosted(**params).fit(x[~test], y[~test], w).margin(x[test])
    return out


def serially(run, shared, items: list) -> list:
    return [run(shared, x) for x in items]


def by_tasks(spark: SparkSession):
    """The same with one task for each item; what the tasks share is broadcast and bounded, as is what they return."""

    def spread(run, shared, items: list) -> list:
        sent = spark.sparkContext.broadcast((shared, items))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                own, given = sent.value
                for i in pdf["id"]:
                    yield from frames({"id": [i], "out": [pickle.dumps(run(own, given[i]))]})

        got = spark.range(0, len(items), 1, max(1, len(items))).mapInPandas(work, "id long, out binary").collect()
        return [pickle.loads(r["out"]) for r in sorted(got, key=lambda r: r["id"])]

    return spread
