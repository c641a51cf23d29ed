"""Trees: attribution against subsets, growth by shape, predictions of both forms."""

import itertools
import math

import numpy as np
import pytest

from barloom.operators import boosting, models as ml, trees

NAMES = ["a", "b", "c", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 2)
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) + x[:, 2])))
    y = (rng.random(600) < p).astype(int)
    return spark.createDataFrame([(f"s{i % 7}", i, *map(float, r), int(k), "kept") for i, (r, k) in enumerate(zip(x, y))], "symbol string, d int, a double, b double, c double, e double, label int, base string").cache()


def expected(tree, node, x, known):
    """A tree's value where only some features are known: training rows decide between the sides of a split."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expected(tree, left if x[f] <= tree.threshold[node] else right, x, known)
    return sum(float(tree.cover[k]) * expected(tree, k, x, known) for k in (left, right)) / float(tree.cover[node])


def by_subsets(ensemble, x):
    n = len(ensemble.names)
    value = {s: ensemble.base + sum(expected(t, 0, x, set(s)) for t in ensemble.trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value[tuple(sorted((*s, i)))] - value[s]) for k in range(n) for s in itertools.combinations(rest, k)))
    return out, value[()]


@pytest.mark.parametrize("family,params", [("random_forest", {"trees": 5, "depth": 4}), ("gradient_boosting", {"trees": 4, "depth": 3}), ("oblivious_boosting", {"trees": 3, "depth": 3}), ("leafwise_boosting", {"trees": 3, "depth": 3})])
def test_effects_equal_all_subsets_and_add_up(spark, rows, family, params):
    model = ml.fit(family, params, rows, NAMES)
    ensemble = model if isinstance(model, trees.Ensemble) else trees.of_forest(spark, model.stages[-1], NAMES)
    probability = {r.d: r.probability for r in ml.predict(model, rows).collect()}
    got = {}
    for r in ml.explain(model, rows, NAMES, None).collect():
        got.setdefault(r.d, []).append(r)
    values = {r.d: np.array([r[n] for n in NAMES]) for r in rows.collect()}
    assert len(got) == 600
    for d, parts in got.items():
        assert sorted(p["rank"] for p in parts) == [1, 2, 3, 4] and abs(sum(p.effect for p in parts) + parts[0].base - parts[0].prediction) < 1e-9
        p = 1 / (1 + math.exp(-parts[0].prediction)) if ensemble.logistic else parts[0].prediction
        assert abs(p - probability[d]) < 1e-9
    for d in range(0, 600, 25):
        want, base = by_subsets(ensemble, values[d])
        effect = {p.feature: p.effect for p in got[d]}
        assert abs(base - got[d][0].base) < 1e-9 and all(abs(effect[n] - w) < 1e-9 for n, w in zip(NAMES, want))
    assert [p.feature for p in sorted(got[0], key=lambda p: p["rank"])] == [p.feature for p in sorted(got[0], key=lambda p: (-abs(p.effect), p.feature))]


def test_oblivious_trees_have_one_split_for_each_level(spark, rows):
    model = ml.fit("oblivious_boosting", {"trees": 4, "depth": 3}, rows, NAMES)
    for t in model.trees:
        level, deep = [0], 0
        while (t.feature[level] >= 0).any():
            assert len({(int(t.feature[k]), float(t.threshold[k])) for k in level}) == 1
            level, deep = [int(c) for k in level for c in (t.left[k], t.right[k])], deep + 1
        assert 1 <= deep <= 3 and len(level) == 2**deep


def test_leafwise_trees_split_the_best_leaf(spark, rows):
    model = ml.fit("leafwise_boosting", {"trees": 2, "depth": 3}, rows, NAMES)
    depths = []
    for t in model.trees:
        assert int((t.feature < 0).sum()) == 7  # 2 ** depth - 1 leaves
        todo = [(0, 0)]
        while todo:
            k, deep = todo.pop()
            if t.feature[k] < 0:
                depths.append(deep)
            else:
                assert t.cover[k] == t.cover[t.left[k]] + t.cover[t.right[k]]
                todo += [(int(t.left[k]), deep + 1), (int(t.right[k]), deep + 1)]
    assert len(set(depths)) > 1  # not grown level by level


def test_first_split_is_the_best_of_all(spark, rows):
    """Against trying every feature and cut on the driver."""
    p = boosting.Params(trees=1, depth=1, step=1.0)
    model = boosting.fit(rows, NAMES, p)
    got = rows.collect()
    x, y = np.array([[r[n] for n in NAMES] for r in got]), np.array([r.label for r in got], float)
    prior = 1 / (1 + np.exp(-model.base))
    g, h = prior - y, np.full(len(y), prior * (1 - prior))
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (x[:, f] <= c, x[:, f] > c)), f, c) for f, cut in enumerate(boosting.edges(rows, NAMES)) for c in cut)
    t = model.trees[0]
    assert (int(t.feature[0]), float(t.threshold[0])) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.isclose(t.value[t.left[0]], -g[left].sum() / (h[left].sum() + 1)) and t.cover[t.left[0]] == left.sum()


def test_boosting_learns_and_handles_small_tables(spark, rows):
    for family in ml.BOOSTED:
        model = ml.fit(family, {"trees": 8, "depth": 3, "step": 0.3}, rows, NAMES)
        hits = ml.predict(model, rows).selectExpr("avg(cast(predicted = actual as int))").first()[0]
        assert hits > 0.75 and abs(sum(ml.importance(model, NAMES).values()) - 1) < 1e-9
        empty = ml.fit(family, {"trees": 2}, rows.limit(0), NAMES)
        assert {r.probability for r in ml.predict(empty, rows).collect()} == {0.5}
        one = ml.fit(family, {"trees": 2}, rows.where("label = 1").limit(3), NAMES)
        assert all(r.probability > 0.5 for r in ml.predict(one, rows.limit(5)).collect())
    nulls = rows.limit(3).selectExpr("symbol", "d", "cast(null as double) as a", "b", "c", "e", "label")
    assert ml.predict(ml.fit("leafwise_boosting", {"trees": 1}, rows, NAMES), nulls).count() == 0
