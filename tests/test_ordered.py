"""Order statistics over ranges of tasks, against plain forms on one machine."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import models as ml, ordered


def test_running_sums_and_numbers(spark):
    rng = np.random.default_rng(0)
    rows = [(None if rng.random() < 0.1 else int(rng.integers(0, 40)), i, int(rng.integers(0, 5)), "kept") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, i int, w int, _part string").repartition(7)
    want, total = {}, 0
    for k, i, w, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += w
        want[i] = total
    got = ordered.running(df, ["k", "i"], "w", "sum")
    assert got.columns == ["k", "i", "w", "_part", "sum"] and {r["i"]: r["sum"] for r in got.collect()} == want
    n = ordered.numbered(df, ["i"], "n", 5).collect()
    assert all(r["n"] == r["i"] + 6 for r in n)
    assert ordered.numbered(df.limit(0), ["i"], "n").count() == 0
    by_tie = ordered.numbered(df, ["k"], "n").collect()
    assert sorted(r["n"] for r in by_tie) == list(range(1, 1001))


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    """A third of all rows holds one value, and a key holds most rows."""
    rng = np.random.default_rng(seed)
    rows = [("hot" if rng.random() < 0.8 else None if rng.random() < 0.1 else f"k{rng.integers(0, 9)}", 7.0 if rng.random() < 0.3 else None if rng.random() < 0.05 else float(rng.normal())) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.05, 0.3333, 0.5, 0.9, 1.0]
    got = {r.k: r for r in ordered.quantiles(df, "v", probs, "k").collect()}
    keys = {k for k, v in rows if v is not None}
    assert set(got) == keys
    for k in keys:
        mine = [v for x, v in rows if x == k and v is not None]
        assert got[k].n == len(mine) and np.allclose(got[k].q, np.quantile(mine, probs), rtol=1e-12, atol=1e-12)
    r = ordered.quantiles(df, "v", probs).first()
    assert np.allclose(r.q, np.quantile([v for _, v in rows if v is not None], probs), rtol=1e-12, atol=1e-12)
    plan = ordered.quantiles(df, "v", probs)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 200).select(ordered.digamma(F.col("id").cast("double")).alias("p")).collect()]
    want, total = [], -0.5772156649015329
    for n in range(1, 200):
        want.append(total)
        total += 1 / n
    assert np.allclose(got, want, atol=1e-10)


def harmonic(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain_information(x, y, k):
    """Every row against every row."""
    n, sums = 0, 0.0
    sizes = Counter(y)
    for i in range(len(x)):
        c = sizes[y[i]]
        if c < 2:
            continue
        near = min(k, c - 1)
        others = sorted((abs(x[j] - x[i]), x[j]) for j in range(len(x)) if j != i and y[j] == y[i])
        r, v = others[near - 1]
        keep = [x[j] for j in range(len(x)) if sizes[y[j]] > 1]
        low, high = v if v < x[i] else x[i] - r, v if v > x[i] else x[i] + r
        m = sum(a == x[i] for a in keep) if r == 0 else sum(low < a < high for a in keep)
        n += 1
        sums += harmonic(near) - harmonic(c) - harmonic(m)
    return max(0.0, harmonic(n) + sums / n)


@pytest.mark.parametrize("block", [10, 100_000])
def test_neighbour_information_equals_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    n = 400
    y = rng.integers(0, 2, n)
    cols = {"close": y + rng.normal(size=n), "noise": rng.normal(size=n), "ties": np.round(y * 0.5 + rng.normal(size=n), 1), "flat": np.ones(n)}
    rows = [(*(float(c[i]) for c in cols.values()), int(y[i])) for i in range(n)] + [(0.5, 0.1, 0.1, 1.0, 9), (None, 0.2, 0.3, 1.0, 1), (0.3, 0.2, 0.3, 1.0, None)]
    df = spark.createDataFrame(rows, "close double, noise double, ties double, flat double, label int").repartition(3)
    got = {r.feature: r.mi for r in ordered.neighbour_information(df, list(cols), block=block).collect()}
    for c, name in enumerate(cols):
        mine = [(r[c], r[4]) for r in rows if r[c] is not None and r[4] is not None]
        assert math.isclose(got[name], plain_information([a for a, _ in mine], [b for _, b in mine], 3), abs_tol=1e-9), name
    assert got["close"] > got["noise"]


def test_neighbour_information_of_two_thousand_rows(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 2000)
    x = np.round(y * 0.7 + rng.normal(size=2000), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, label int")
    got = ml.mutual_information(df, ["x"]).first().mi
    assert math.isclose(got, plain_information(x.tolist(), y.tolist(), 3), abs_tol=1e-9)
    assert ml.mutual_information(df.limit(0), ["x"]).first().mi == 0.0
