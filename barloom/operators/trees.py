"""Ensembles of decision trees as flat node tables: prediction, and what each feature adds to a prediction.

A tree's nodes are arrays, so an ensemble is small and goes to the tasks whole; rows come in Arrow batches.

Attribution is by Shapley values along the trees' own paths. Where a feature is not in the known subset, a row goes both ways, in
the proportions in which training rows went. For one leaf, let o be 1 for each feature whose splits on the leaf's path the row
passes, and z the share of training rows that pass them. A subset of known features reaches the leaf with weight prod(o in
it) * prod(z outside it). The Shapley weight s!(m-s-1)!/m! of a subset of s of the m other features is the integral of
t^s (1-t)^(m-1-s), so the sum over all subsets is one integral of prod(z (1-t) + o t): a polynomial of known degree, which
Gauss-Legendre points integrate exactly. So a leaf costs features times points, not subsets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables


@dataclass(frozen=True)
class Tree:
    """Nodes from the root (0) on. Rows with feature value <= threshold go left; leaves have feature -1 and a value; cover is the weight of training rows."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            left = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(left, self.left[node], self.right[node])

    def paths(self) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
        """For each leaf: value, and (feature, low, high, share): rows with low < x <= high pass, share of training rows did."""
        out, todo = [], [(0, {})]
        while todo:
            node, path = todo.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((float(self.value[node]), [(k, *v) for k, v in path.items()]))
                continue
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            cut = float(self.threshold[node])
            for child, lo, hi in ((int(self.left[node]), low, min(high, cut)), (int(self.right[node]), max(low, cut), high)):
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.5
                todo.append((child, {**path, f: (lo, hi, share * float(part))}))
        return out


@dataclass(frozen=True)
class Ensemble:
    """base plus the sum of the trees' leaf values; for a logistic ensemble that is a log of odds, else a probability."""

    names: tuple[str, ...]
    trees: tuple[Tree, ...]
    base: float = 0.0
    logistic: bool = False

    def total(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf(x)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = self.total(x)
        return 1 / (1 + np.exp(-total)) if self.logistic else total

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """(rows, features) effects, and what is expected without a known feature; they add up to `total`."""
        out, expected = np.zeros((len(x), len(self.names))), self.base
        for t in self.trees:
            for value, path in t.paths():
                expected += value * float(np.prod([share for *_, share in path]))
                m = len(path)
                if not m or not value:
                    continue
                at, weight = np.polynomial.legendre.leggauss(m // 2 + 1)
                at, weight = (at + 1) / 2, weight / 2
                pass_ = np.stack([(x[:, f] > low) & (x[:, f] <= high) for f, low, high, _ in path], axis=1).astype(float)
                share = np.array([p[3] for p in path])
                term = share[:, None] * (1 - at) + pass_[:, :, None] * at  # rows, features of the path, points
                before, after = np.ones_like(term), np.ones_like(term)
                np.cumprod(term[:, :-1], axis=1, out=before[:, 1:])
                after[:, :-1] = np.cumprod(term[:, :0:-1], axis=1)[:, ::-1]
                others = (before * after) @ weight
                for i, (f, *_) in enumerate(path):
                    out[:, f] += value * (pass_[:, i] - share[i]) * others[:, i]
        return out, expected

    def importance(self) -> dict[str, float]:
        """By feature: the share of training rows that its splits divide, of those that all splits do."""
        total = np.zeros(len(self.names))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.cover[inner])
        return dict(zip(self.names, (total / total.sum() if total.sum() else total).tolist()))

    def _matrix(self, b: pa.RecordBatch, first: int) -> np.ndarray:
        return np.column_stack([np.asarray(b.column(first + i).to_numpy(zero_copy_only=False), float) for i in range(len(self.names))])

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows without NULL features, with their probability."""
        schema = T.StructType([*rows.schema.fields, T.StructField("probability", T.DoubleType())])
        at = [rows.columns.index(n) for n in self.names]

        def run(batches):
            for b in batches:
                x = np.column_stack([np.asarray(b.column(i).to_numpy(zero_copy_only=False), float) for i in at]) if len(b) else np.zeros((0, len(at)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.probability(x))], names=schema.names)

        return rows.na.drop(subset=list(self.names)).mapInArrow(run, schema)

    def explain(self, rows: DataFrame, keys: tuple[str, ...] = ("symbol", "d"), top: int | None = 5) -> DataFrame:
        """keys, prediction, base, feature, effect, rank: the effects of a row, largest first; all of them add up to prediction - base."""
        kept = rows.na.drop(subset=list(self.names)).select(*keys, *(F.col(n).cast("double").alias(n) for n in self.names))
        schema = T.StructType([*kept.select(*keys).schema.fields, T.StructField("prediction", T.DoubleType()), T.StructField("base", T.DoubleType()), T.StructField("effects", T.ArrayType(T.DoubleType()))])
        n = len(self.names)

        def run(batches):
            for b in batches:
                x = self._matrix(b, len(keys)) if len(b) else np.zeros((0, n))
                effects, base = self.effects(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(effects.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(self.total(x)), pa.array(np.full(len(x), base)), lists], names=schema.names)

        made = kept.mapInArrow(run, schema)
        # ranked inside the row: no exchange
        pairs = F.transform("effects", lambda e, i: F.struct((-F.abs(e)).alias("size"), F.element_at(F.lit(list(self.names)), i + 1).alias("feature"), e.alias("effect")))
        out = made.select(*keys, "prediction", "base", F.posexplode(F.slice(F.array_sort(pairs), 1, top or n)).alias("rank", "e"))
        return out.select(*keys, "prediction", "base", F.col("e.feature").alias("feature"), F.col("e.effect").alias("effect"), (F.col("rank") + 1).alias("rank"))


def of_forest(spark: SparkSession, model, names: list[str]) -> Ensemble:
    """The node tables of a fitted tree ensemble of pyspark.ml (forest or boosted, with two classes), from its own stored form."""
    path = tables.shared(spark, "forest")
    model.write().overwrite().save(path)
    boosted, weights = "GBT" in type(model).__name__, list(model.treeWeights)
    by_tree: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # a model: bounded by its trees' number and depth
        by_tree.setdefault(r["treeID"], []).append(r)
    made = []
    for k in sorted(by_tree):
        nodes = sorted(by_tree[k], key=lambda r: r["id"])
        if boosted:  # twice the margin is the log of odds; the statistics of a regression tree begin with the weight
            value, cover = [2 * weights[k] * r["prediction"] for r in nodes], [r["impurityStats"][0] for r in nodes]
        else:
            cover = [sum(r["impurityStats"]) for r in nodes]
            value = [r["impurityStats"][1] / c / len(by_tree) if c else 0.0 for r, c in zip(nodes, cover)]
        inner = [r["leftChild"] >= 0 for r in nodes]
        made.append(Tree(
            np.array([r["split"]["featureIndex"] if i else -1 for r, i in zip(nodes, inner)]), np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for r, i in zip(nodes, inner)]),
            np.array([r["leftChild"] for r in nodes]), np.array([r["rightChild"] for r in nodes]), np.array(value), np.array(cover, float),
        ))
    return Ensemble(tuple(names), tuple(made), 0.0, boosted)
