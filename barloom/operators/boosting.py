"""Gradient boosting on histograms, with two ways to grow a tree.

Rows stay where they are: for a set of nodes, each task adds up gradients, second derivatives and counts by (node, feature, bin)
over its rows, and these sums, whose number doesn't depend on the rows, are added by key. The driver chooses splits from them.
A row's margin and node are computed anew from the trees so far, so a lost task needs nothing but its rows.

- *Oblivious* trees have one split for each level, the one with the largest gain over all nodes of the level: as many jobs as levels.
- *Leaf-wise* trees split the leaf with the largest gain, until there are `leaves`: a job for each split.

Bins come from one approximate percentile aggregate; a split is a bin's upper edge, so rows with value <= edge go left.
Rows with a NULL feature or label are left out. Without rows, or where no split gains, a tree is a single leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from .trees import Ensemble, Tree

BINS = 32


@dataclass(frozen=True)
class Params:
    trees: int = 20
    depth: int = 4
    leaves: int = 8
    step: float = 0.1
    smooth: float = 1.0
    least: int = 5
    oblivious: bool = True


def edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct cut points of each feature, at most bins - 1."""
    at = [i / bins for i in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.col(n).cast("double"), at, 10_000).alias(n) for n in names)).first()
    return [np.unique(got[n]) if got[n] is not None else np.zeros(0) for n in names]


def _leaf(value: float, cover: float) -> Tree:
    one = np.zeros(1, np.int64)
    return Tree(one - 1, np.zeros(1), one - 1, one - 1, np.array([value]), np.array([cover]))


def _split(tree: Tree, node: int, feature: int, threshold: float) -> Tree:
    """tree with two new leaves under node."""
    n = len(tree.feature)
    put = lambda a, v, new: np.append(np.where(np.arange(n) == node, v, a), new)
    return Tree(put(tree.feature, feature, [-1, -1]), put(tree.threshold, threshold, [0.0, 0.0]), put(tree.left, n, [-1, -1]), put(tree.right, n + 1, [-1, -1]), np.append(tree.value, [0.0, 0.0]), np.append(tree.cover, [0.0, 0.0]))


def histograms(rows: DataFrame, model: Ensemble, tree: Tree, nodes: list[int], cuts: list[np.ndarray]) -> np.ndarray:
    """(nodes, features, bins, 3): sums of gradient, second derivative and rows of the rows that are in each of the nodes."""
    width = max(map(len, cuts), default=0) + 1
    shape = (len(nodes), len(cuts), width, 3)
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))

    def run(batches):
        out = np.zeros((int(np.prod(shape[:3])), 3))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(cuts))])
            y = b.column(len(cuts)).to_numpy(zero_copy_only=False)
            at = place[tree.leaf(x)]
            x, y, at = x[at >= 0], y[at >= 0], at[at >= 0]
            p = model.probability(x)
            for f, cut in enumerate(cuts):
                cell = (at * len(cuts) + f) * width + np.searchsorted(cut, x[:, f], "left")
                for k, v in enumerate((p - y, p * (1 - p), np.ones(len(y)))):
                    out[:, k] += np.bincount(cell, v, len(out))
        some = np.flatnonzero(out[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(out[some, k]) for k in range(3))], names=["cell", "g", "h", "n"])

    got = rows.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("n")).toArrow()
    out = np.zeros((int(np.prod(shape[:3])), 3))
    out[got.column(0).to_numpy()] = np.column_stack([got.column(k).to_numpy() for k in (1, 2, 3)])
    return out.reshape(shape)


def gains(h: np.ndarray, cuts: list[np.ndarray], p: Params) -> np.ndarray:
    """(nodes, features, bins): what a split after each bin gains; -inf where a side has too few rows."""
    left = np.cumsum(h, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + p.smooth)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 2] < p.least) | (right[..., 2] < p.least)] = -np.inf
    for f, cut in enumerate(cuts):
        gain[:, f, len(cut):] = -np.inf
    return gain


def _valued(tree: Tree, sums: dict[int, np.ndarray], p: Params) -> Tree:
    """Leaf values and covers from the sums of the nodes."""
    value, cover = np.zeros(len(tree.feature)), np.zeros(len(tree.feature))
    for node, (g, h, n) in sums.items():
        cover[node] = n
        if tree.feature[node] < 0:
            value[node] = -p.step * g / (h + p.smooth)
    return replace(tree, value=value, cover=cover)


def _grow_oblivious(rows: DataFrame, model: Ensemble, cuts: list[np.ndarray], p: Params) -> Tree:
    tree, level, sums = _leaf(0.0, 0.0), [0], {}
    for depth in range(p.depth + 1):
        h = histograms(rows, model, tree, level, cuts)
        sums |= {node: h[i, 0].sum(axis=0) for i, node in enumerate(level)}
        if depth == p.depth:
            break
        gain = gains(h, cuts, replace(p, least=0)).sum(axis=0)
        gain[~np.isfinite(gains(h, cuts, p)).any(axis=0)] = -np.inf  # it has to divide one node at least
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, b] > 1e-9:
            break
        below = []
        for node in level:
            tree = _split(tree, node, int(f), float(cuts[f][b]))
            below += [len(tree.feature) - 2, len(tree.feature) - 1]
        level = below
    return _valued(tree, sums, p)


def _grow_leafwise(rows: DataFrame, model: Ensemble, cuts: list[np.ndarray], p: Params) -> Tree:
    tree, new, sums, open_ = _leaf(0.0, 0.0), [0], {}, {}
    while True:
        h = histograms(rows, model, tree, new, cuts)
        gain = gains(h, cuts, p)
        for i, node in enumerate(new):
            sums[node] = h[i, 0].sum(axis=0)
            f, b = np.unravel_index(int(gain[i].argmax()), gain[i].shape)
            if gain[i, f, b] > 1e-9:
                open_[node] = (float(gain[i, f, b]), int(f), int(b))
        if not open_ or len(sums) - len(sums) // 2 >= p.leaves:
            return _valued(tree, sums, p)
        node = max(open_, key=lambda k: (open_[k][0], -k))
        _, f, b = open_.pop(node)
        tree = _split(tree, node, f, float(cuts[f][b]))
        new = [len(tree.feature) - 2, len(tree.feature) - 1]


def fit(rows: DataFrame, names: list[str], params: Params, label: str = "label") -> Ensemble:
    """A logistic ensemble of params.trees trees. The rows are written down once and read by each job."""
    spark = rows.sparkSession
    path = tables.shared(spark, "boosting")
    rows.select(*(F.col(n).cast("double").alias(n) for n in names), F.col(label).cast("double").alias("_y")).na.drop().write.parquet(path)
    rows = spark.read.parquet(path)
    n, up = rows.agg(F.count("*"), F.sum("_y")).first()
    odds = math.log((up + 1) / (n - up + 1)) if n else 0.0
    model = Ensemble(tuple(names), (), odds, True)
    if not n:
        return model
    cuts = edges(rows, names)
    for _ in range(params.trees):
        tree = (_grow_oblivious if params.oblivious else _grow_leafwise)(rows, model, cuts, params)
        model = replace(model, trees=(*model.trees, tree))
    return model
