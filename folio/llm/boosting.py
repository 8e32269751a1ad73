"""Gradient-boosted trees for a logistic target, with monotonic constraints, kept as flat numpy arrays.

Every tree is a complete binary tree of one depth: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``. All trees lie in
two arrays (split feature, split value) and one of leaf values, so rows and trees are scored together without a loop over
nodes. Features are binned by the quantiles of the training rows. ``fit`` takes rows at hand; ``fit_dealt`` takes a table of any
size, of which only the sums of a level's bins come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients are added up as whole multiples of one part in so many, so that the order of the rows has no say in the sums.
PARTS = 1 << 24


@dataclass(frozen=True)
class Boosted:
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # trees x inner nodes; to the left if value <= split
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        trees, inner = self.feature.shape
        depth = int(np.log2(inner + 1))
        node = np.zeros((len(x), trees), "int64")
        column, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range(depth):
            right = x[row, self.feature[column, node]] > self.split[column, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[column, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, in blocks of rows so that memory stays bounded."""
        parts = [self.margin(x[i : i + 4096]) for i in range(0, len(x), 4096)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _choose(sums: Iterable[tuple[int, np.ndarray, np.ndarray]], total_g: float, total_h: float, low: float, high: float, monotone: dict[int, int], ridge: float, least: float) -> tuple[int, int, float, float] | None:
    """``(feature, cut, left value, right value)`` of the best split of a node, from ``(feature, g, h)``: the sums up to each cut."""
    best, chosen = 1e-9, None
    for f, g, h in sums:
        left, right = g / (h + ridge), (total_g - g) / (total_h - h + ridge)
        allowed = (h >= least / 4) & (total_h - h >= least / 4)
        if sign := monotone.get(f, 0):
            allowed &= sign * (np.clip(right, low, high) - np.clip(left, low, high)) >= 0
        gain = np.where(allowed, _gain(g, h, ridge) + _gain(total_g - g, total_h - h, ridge) - _gain(total_g, total_h, ridge), -1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, chosen = gain[k], (f, k, np.clip(left[k], low, high), np.clip(right[k], low, high))
    return chosen


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 48, least: float = 5.0, weight: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> Boosted | None:
    """Fit to ``y`` in 0/1; a row counts ``weight`` times, and ``cuts`` are the splits of each feature, if they are known. ``monotone[f]`` is 1 or -1 where the score must not fall or not rise with feature ``f``.

    Splits that break a constraint are not taken, and the middle of two constrained children bounds all leaves below them,
    which makes each tree, and so the sum, monotone. None if ``y`` has one class only.
    """
    y = np.asarray(y, "float64")
    if len(y) == 0 or y.min() == y.max():
        return None
    monotone = monotone or {}
    whole = (lambda x: np.rint(x * PARTS) / PARTS) if weight is not None else (lambda x: x)  # noqa: E731  as in fit_dealt
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, "float64")
    cuts = cuts or [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    inner, base = 2**depth - 1, float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    feature, split = np.zeros((trees, inner), "int64"), np.full((trees, inner), np.inf)
    leaf, margin = np.zeros((trees, inner + 1)), np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = whole(weight * (y - p)), whole(weight * np.maximum(p * (1 - p), 1e-6))
        node = np.zeros(len(y), "int64")
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for n in range(inner):
            rows = np.flatnonzero(node == n)
            low[2 * n + 1 : 2 * n + 3], high[2 * n + 1 : 2 * n + 3] = low[n], high[n]
            chosen = None
            if len(rows) >= 2:
                upto = lambda f, of: np.bincount(codes[rows, f], of[rows], len(cuts[f]) + 1).cumsum()[:-1]  # noqa: B023, E731
                sums = ((f, upto(f, grad), upto(f, hess)) for f, c in enumerate(cuts) if len(c))
                chosen = _choose(sums, grad[rows].sum(), hess[rows].sum(), low[n], high[n], monotone, ridge, least)
            if chosen is None:  # all rows go left
                node[rows] = 2 * n + 1
                continue
            f, k, left_value, right_value = chosen
            feature[t, n], split[t, n] = f, cuts[f][k]
            node[rows] = 2 * n + 1 + (codes[rows, f] > k)
            if sign := monotone.get(f, 0):
                middle = (left_value + right_value) / 2
                lower, upper = (2 * n + 1, 2 * n + 2) if sign > 0 else (2 * n + 2, 2 * n + 1)
                high[lower], low[upper] = min(high[lower], middle), max(low[upper], middle)
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        leaf[t] = rate * np.clip(g / (h + ridge), low[inner:], high[inner:])
        margin += leaf[t][node - inner]
    return Boosted(feature, split, leaf, base)


def coded_margin(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float) -> np.ndarray:
    """The margin of rows of bins: to the left where the bin is at most ``cut``."""
    trees, row = np.arange(len(leaf))[None, :], np.arange(len(codes))[:, None]
    node = np.zeros((len(codes), len(leaf)), "int64")
    for _ in range(int(np.log2(feature.shape[1] + 1))):
        node = 2 * node + 1 + (codes[row, feature[trees, node]] > cut[trees, node])
    return base + leaf[trees, node - feature.shape[1]].sum(axis=1)


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    """The bins of the rows of a batch, from its column ``cell``, a byte a feature."""
    return np.frombuffer(b"".join(batch.column("cell").to_pylist()), "u1").reshape(batch.num_rows, -1)


def _level_sums(cells: DataFrame, shape: tuple[int, int, int], feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and their slopes by node of a level, feature and bin (``shape``), over all of ``cells(y, n, cell)``; of ``feature`` and
    ``cut`` the last row is the tree that grows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, int(np.prod(shape))))
        for batch in batches:
            codes, y, n = codes_of(batch), batch.column("y").to_numpy(), batch.column("n").to_numpy()
            p = 1 / (1 + np.exp(-coded_margin(codes, feature[:-1], cut[:-1], leaf, base)))
            node = np.zeros(len(y), "int64")
            for _ in range(int(np.log2(shape[0]))):
                node = 2 * node + 1 + (codes[np.arange(len(y)), feature[-1][node]] > cut[-1][node])
            slot = (((node - (shape[0] - 1))[:, None] * shape[1] + np.arange(shape[1])) * shape[2] + codes).ravel()
            for k, of in enumerate((n * (y - p), n * np.maximum(p * (1 - p), 1e-6))):
                total[k] += np.bincount(slot, np.repeat(np.rint(of * PARTS), shape[1]), total.shape[1])
        there = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(there.astype("i4")), *[pa.array(t[there].astype("i8")) for t in total]], ["slot", "g", "h"])

    found = cells.mapInArrow(sums, "slot int, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, int(np.prod(shape))))
    for k, name in enumerate(("g", "h")):
        out[k, found["slot"].to_numpy()] = found[name].to_numpy() / PARTS
    return out[0].reshape(shape), out[1].reshape(shape)


def fit_dealt(cells: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> tuple[Boosted, np.ndarray] | None:
    """What ``fit`` gives for ``cells(y int, n long, cell binary)``, rows of bins with their numbers, and the cuts of its splits by number.

    The rows stay where they are: of each level of each tree, a pass over them adds up gradients by node, feature and bin.
    """
    of = {r["y"]: r["n"] for r in cells.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(of) < 2:
        return None
    inner, base = 2**depth - 1, float(np.log(of[1] / of[0]))
    feature, cut, split = np.zeros((trees, inner), "int64"), np.full((trees, inner), 255), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        for level in range(depth):
            shape = (2**level, len(cuts), max(map(len, cuts)) + 1)
            g, h = _level_sums(cells, shape, feature[: t + 1], cut[: t + 1], leaf[:t], base)
            for i, n in enumerate(range(shape[0] - 1, 2 * shape[0] - 1)):
                total_g, total_h = g[i, 0].sum(), h[i, 0].sum()
                sums = ((f, g[i, f, : len(c) + 1].cumsum()[:-1], h[i, f, : len(c) + 1].cumsum()[:-1]) for f, c in enumerate(cuts) if len(c))
                chosen = _choose(sums, total_g, total_h, -np.inf, np.inf, {}, ridge, least)
                left_g, left_h = total_g, total_h
                if chosen is not None:  # else all rows go left
                    f, k, _, _ = chosen
                    feature[t, n], cut[t, n], split[t, n] = f, k, cuts[f][k]
                    left_g, left_h = g[i, f, : k + 1].sum(), h[i, f, : k + 1].sum()
                if level == depth - 1:
                    leaf[t, 2 * i] = rate * left_g / (left_h + ridge)
                    leaf[t, 2 * i + 1] = rate * (total_g - left_g) / (total_h - left_h + ridge)
    return Boosted(feature, split, leaf, base), cut
