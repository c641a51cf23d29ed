"""Evaluation of predictions: metrics, calibration, drift, confidence and promotion rules, chronological splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands
from .ordered import quantiles

EPS = 2.220446049250313e-16


def _rate(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def counts(y: str = "actual", p: str = "predicted") -> dict[str, Column]:
    a, b = F.col(y), F.col(p)
    return {"tp": F.count_if((a == 1) & (b == 1)), "fp": F.count_if((a == 0) & (b == 1)), "fn": F.count_if((a == 1) & (b == 0)), "tn": F.count_if((a == 0) & (b == 0))}


def performance(preds: DataFrame, *keys: str) -> DataFrame:
    """n, accuracy, precision, recall, f1 of resolved predictions; a rate without a base is 0, all are NULL for no rows."""
    df = preds.where("actual is not null")
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    out = df.groupBy(*keys).agg(*(c.alias(n) for n, c in counts().items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    some = lambda c: F.when(n > 0, c)
    return out.select(*keys, n.alias("n"), some((tp + tn) / F.nullif(n, F.lit(0))).alias("accuracy"), some(_rate(tp, tp + fp)).alias("precision"), some(_rate(tp, tp + fn)).alias("recall"), some(_rate(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def confusion(preds: DataFrame) -> DataFrame:
    """All four cells, 0 where empty."""
    cells = [(a, b, n) for n, (a, b) in {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}.items()]
    row = preds.agg(*(c.alias(n) for n, c in counts().items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("n")) for a, b, n in cells))).alias("x")).select("x.*")


def score_table(preds: DataFrame, *keys: str) -> DataFrame:
    """Rows and positives of each distinct score: what ranking metrics need, aggregated before any sort."""
    return preds.where("actual is not null and probability is not null").groupBy(*keys, "probability").agg(F.count("*").alias("n"), F.sum("actual").cast("long").alias("pos"))


def ranking_metrics(preds: DataFrame, *keys: str) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per key."""
    s = score_table(preds, *keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("probability"))
    s = s.withColumns({"tp": F.sum("pos").over(w), "all": F.sum("n").over(w)})
    neg = F.col("n") - F.col("pos")
    part = F.sum(neg * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    out = s.groupBy(*keys).agg(part.alias("a"), F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("ap"))
    return out.select(*keys, F.try_divide(F.col("a"), F.col("p") * (F.col("n") - F.col("p"))).alias("roc_auc"), F.try_divide(F.col("ap"), F.col("p")).alias("pr_auc"))


def classification(preds: DataFrame, *keys: str) -> DataFrame:
    """Accuracy, precision, recall, f1, log loss (clipped), Matthews correlation, balanced accuracy, Brier, ROC-AUC and average precision."""
    df = preds.where("actual is not null and probability is not null")
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col("probability")))
    y = F.col("actual")
    out = df.groupBy(*keys).agg(*(c.cast("double").alias(n) for n, c in counts().items()), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(F.pow(F.col("probability") - y, 2)).alias("brier"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    mcc = _rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    out = out.select(
        *keys, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1"), "log_loss", "brier", mcc.alias("mcc"),
        ((_rate(tp, tp + fn) + _rate(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )
    rank = ranking_metrics(preds, *keys)
    return out.join(rank, list(keys)) if keys else out.join(rank)


def calibration_bins(preds: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean probability, positive rate; bins closed on the left at i * (1 / bins) in doubles, 1.0 in the last."""
    edge = [i * (1.0 / bins) for i in range(1, bins)]
    at = sum(((F.col("probability") >= e).cast("int") for e in edge), F.lit(0))
    return preds.where("actual is not null and probability is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_p"), F.avg("actual").alias("rate"))


def calibration_error(preds: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return calibration_bins(preds, bins).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def apply_temperature(p: Column, t: float) -> Column:
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return 1 / (1 + F.exp(-F.ln(q / (1 - q)) / t))


def fit_temperature(preds: DataFrame, low: float = 0.05, high: float = 20.0, rounds: int = 3, steps: int = 41) -> float:
    """The temperature of least log loss: a grid on a log scale, refined; each round is one aggregate over the scores."""
    import math

    s = score_table(preds).cache()
    try:
        for _ in range(rounds):
            ts = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
            loss = lambda t: F.sum(-(F.col("pos") * F.ln(apply_temperature(F.col("probability"), t)) + (F.col("n") - F.col("pos")) * F.ln(1 - apply_temperature(F.col("probability"), t))))
            row = s.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(ts))).first()
            best = min(range(steps), key=lambda i: math.inf if row[i] is None else row[i])
            low, high = ts[max(0, best - 1)], ts[min(steps - 1, best + 1)]
    finally:
        s.unpersist()
    return math.sqrt(low * high)


def psi(train: DataFrame, live: DataFrame, value: str, *keys: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index per key: deciles of train (distinct edges), counts inside the edges, shares of at least eps.
    NULL for fewer than 10 train values or no live ones, 0 for fewer than 3 edges."""
    cut = quantiles(train, value, [i / bins for i in range(bins + 1)], *keys).select(*keys, F.array_distinct("q").alias("edges"))
    counts = train.groupBy(*keys).agg(F.count(value).alias("n_train"))
    edges = counts.join(cut, list(keys), "left") if keys else counts.join(F.broadcast(cut))

    def shares(df: DataFrame, name: str) -> DataFrame:
        x = F.col(value)
        inside = (x >= F.get("edges", F.lit(0))) & (x <= F.element_at("edges", -1))
        k = F.least(F.size(F.filter("edges", lambda e: e <= x)), F.size("edges") - 1)
        df = df.join(edges, list(keys)) if keys else df.join(F.broadcast(edges))
        return df.where(inside).groupBy(*keys, k.alias("bin")).agg(F.count("*").alias(name))

    live_n = live.groupBy(*keys).agg(F.count(value).alias("n_live"))
    grid = edges.select(*keys, "n_train", F.size("edges").alias("m"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin"))
    on = [*keys, "bin"]
    g = grid.join(shares(train, "a"), on, "left").join(shares(live, "b"), on, "left").na.fill(0, ["a", "b"])
    w = Window.partitionBy(*keys)
    share = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)), F.lit(eps))
    g = g.withColumns({"pa": share("a"), "pb": share("b")})
    out = g.groupBy(*keys).agg(F.sum((F.col("pb") - F.col("pa")) * F.ln(F.col("pb") / F.col("pa"))).alias("v"), F.first("m").alias("m"), F.first("n_train").alias("n_train"))
    out = out.join(live_n, list(keys), "left") if keys else out.join(live_n)
    value_ = F.when((F.col("n_train") < 10) | (F.coalesce("n_live", F.lit(0)) == 0), None).when(F.col("m") < 3, 0.0).otherwise(F.col("v"))
    return out.select(*keys, value_.alias("psi")).withColumn("status", bands.drift(F.col("psi"), 0.10, 0.25))


def prediction_drift(preds: DataFrame, *keys: str) -> DataFrame:
    """Difference of mean probability between the later and the earlier half by date; NULL below 10 rows."""
    w = Window.partitionBy(*keys)
    df = preds.withColumns({"r": F.row_number().over(w.orderBy("d")), "n": F.count("*").over(w)})
    late = F.col("r") > F.floor(F.col("n") / 2)
    out = df.groupBy(*keys).agg(F.first("n").alias("n"), F.abs(F.avg(F.when(late, F.col("probability"))) - F.avg(F.when(~late, F.col("probability")))).alias("x"))
    return out.select(*keys, F.when(F.col("n") >= 10, F.col("x")).alias("drift")).withColumn("status", bands.drift(F.col("drift"), 0.10, 0.25))


def concept_drift(preds: DataFrame, registered: float, *keys: str) -> DataFrame:
    p = performance(preds, *keys)
    return p.select(*keys, F.when(F.col("n") >= 20, registered - F.col("accuracy")).alias("drop")).withColumn("status", bands.drift(F.col("drop"), 0.07, 0.15))


def worst(statuses: DataFrame, *keys: str) -> DataFrame:
    rank = F.array_position(F.array(F.lit("Insufficient Data"), F.lit("No Drift"), F.lit("Moderate Drift"), F.lit("Significant Drift")), F.col("status"))
    return statuses.groupBy(*keys).agg(F.max_by("status", rank).alias("status"))


def importance_drift(snapshots: DataFrame, limit: float = 0.5) -> DataFrame:
    """Latest against previous snapshot of each feature: relative change; infinite from 0."""
    w = Window.partitionBy("feature").orderBy("computed_at")
    df = snapshots.withColumns({"previous": F.lag("value").over(w), "newest": F.lead("value").over(w).isNull()}).where("newest and previous is not null")
    rel = F.when(F.col("previous") == 0, F.when(F.col("value") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.abs(F.col("value") - F.col("previous")) / F.abs("previous"))
    return df.select("feature", "value", "previous", rel.alias("change")).withColumn("drifted", F.col("change") > limit)


# Splits go by distinct dates over all symbols; the date table is small and is joined back by equality.


def ranked_dates(df: DataFrame) -> DataFrame:
    days = df.select("d").distinct()
    w = Window.partitionBy()  # one row per date
    return days.withColumns({"k": F.row_number().over(w.orderBy("d")) - 1, "n": F.count("*").over(w)})


def chronological_split(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    days = ranked_dates(df)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * val)
    return df.join(days.select("d", F.when(F.col("k") < a, "train").when(F.col("k") < b, "val").otherwise("test").alias("part")), "d")


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """fold, train and validation spans: size n // (folds + 1), the last takes the rest."""
    days = ranked_dates(df).withColumn("size", F.floor(F.col("n") / (folds + 1)))
    x = days.select("d", "k", "n", "size", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    end = F.when(F.col("fold") == folds, F.col("n")).otherwise((F.col("fold") + 1) * F.col("size"))
    tr, va = F.col("k") < F.col("fold") * F.col("size"), (F.col("k") >= F.col("fold") * F.col("size")) & (F.col("k") < end)
    when = lambda c: F.when(c, F.col("d"))
    return x.groupBy("fold").agg(F.min(when(tr)).alias("train_start"), F.max(when(tr)).alias("train_end"), F.min(when(va)).alias("val_start"), F.max(when(va)).alias("val_end"), F.count_if(va).alias("val_dates"))


def leakage(folds: DataFrame) -> DataFrame:
    return folds.select("fold", (F.col("val_start") > F.col("train_end")).alias("ok"), F.datediff("val_start", "train_end").alias("gap_days"))


def rolling_folds(n: int | Column, train: int, test: int):
    """Position ranges of fixed windows that step by the test length: array of (train_start, train_end, test_start, test_end), ends excluded."""
    n = F.lit(n) if isinstance(n, int) else n
    count = F.greatest(F.floor((n - train) / test), F.lit(0)).cast("int")
    row = lambda i: F.struct((i * test).alias("train_start"), (i * test + train).alias("train_end"), (i * test + train).alias("test_start"), (i * test + train + test).alias("test_end"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), row)).otherwise(F.array().cast("array<struct<train_start:int,train_end:int,test_start:int,test_end:int>>"))


def end_aligned_folds(n: Column, splits: int = 5, gap: int = 0) -> Column:
    """Expanding folds whose tests of n // (splits + 1) rows end at the last row."""
    size = F.floor(n / (splits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda i: F.struct((n - (splits - i) * size - gap).cast("int").alias("train_end"), (n - (splits - i) * size).cast("int").alias("test_start"), (n - (splits - 1 - i) * size).cast("int").alias("test_end")))


def confidence(preds: DataFrame) -> DataFrame:
    s = bands.confidence_score(F.col("probability"))
    return preds.withColumns({"confidence_score": s, "confidence_level": bands.confidence_level(s), "prediction_class": F.when(F.col("probability") >= 0.5, "UP").otherwise("DOWN")})


def generalization_gate(m: DataFrame) -> DataFrame:
    """Flags of a metric table (train_auc, val_auc, train_accuracy, val_accuracy, baseline, fold_mean, fold_std)."""
    gap = F.abs(F.col("train_auc") - F.col("val_auc")) / F.col("train_auc") * 100
    beat = lambda c: (F.col(c) - F.col("baseline")) / F.col("baseline") * 100
    unstable = F.col("fold_std") / F.col("fold_mean") * 100
    m = m.withColumns({"overfit": gap > 20, "underfit": (beat("train_accuracy") < 5) & (beat("val_accuracy") < 5), "instability": unstable > 15})
    return m.withColumn("passed", ~(F.col("overfit") | F.col("underfit") | F.col("instability")))


def keep_decision(m: DataFrame) -> DataFrame:
    """Kept if the target gains over 0.5% and no second metric (before and after arrays) loses over 1%, with no new failure or flag."""
    gain = F.coalesce((F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)) * 100, F.lit(0.0))
    lost = F.exists(F.zip_with("second_before", "second_after", lambda b, a: F.coalesce((a - b) / F.abs(F.nullif(b, F.lit(0.0))) * 100 < -1.0, F.lit(False))), lambda x: x)
    return m.withColumns({"relative_improvement_pct": gain, "keep": (gain > 0.5) & ~lost & ~F.col("new_failures") & ~F.col("new_flags")})


def stability_metrics(runs: DataFrame, *keys: str) -> DataFrame:
    """Over repeated runs (metric, probability, predicted): population variance, spread, share that agrees with the majority."""
    up = F.avg("predicted")
    return runs.groupBy(*keys).agg(F.var_pop("metric").alias("fold_variance"), F.stddev_pop("probability").alias("probability_std"), F.greatest(up, 1 - up).alias("agreement"))


def wilcoxon_greater(differences: list[float]) -> float | None:
    """p-value of the paired signed-rank test that differences are above 0. Zeros are dropped. Without ties the exact distribution (subset sums of ranks); with ties or zeros the normal one, tie-corrected."""
    import math

    d = [x for x in differences if x != 0]
    if not d:
        return 1.0
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    ranks, i, ties = [0.0] * len(d), 0, 0
    while i < len(d):
        j = i
        while j + 1 < len(d) and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        t = j - i + 1
        ties += t**3 - t
        i = j + 1
    plus, n = sum(r for r, x in zip(ranks, d) if x > 0), len(d)
    if not ties and len(d) == len(differences) and n <= 50:
        ways = [1]
        for r in range(1, n + 1):
            new = ways + [0] * r
            for s, w in enumerate(ways):
                new[s + r] += w
            ways = new
        return sum(ways[int(plus) :]) / 2**n
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 0.5 * math.erfc((plus - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


def promote(challenger: dict, champion: dict | None, alpha: float = 0.05, max_latency_ms: float = 200.0, max_ece: float = 0.15) -> dict:
    """Decision from fold_metrics, ece and latency_ms of two models; without a champion, significance isn't asked for."""
    folds = challenger["fold_metrics"]
    checks = {"walk_forward_passed": len(folds) >= 3 and all(x == x for x in folds), "calibration_acceptable": challenger["ece"] <= max_ece, "latency_acceptable": challenger["latency_ms"] <= max_latency_ms}
    if champion is None:
        return checks | {"promote": all(checks.values()), "p_value": None, "statistically_superior": False}
    p, better = None, False
    if len(folds) == len(champion["fold_metrics"]) >= 3:
        diff = [a - b for a, b in zip(folds, champion["fold_metrics"])]
        p = wilcoxon_greater(diff)
        better = p is not None and p < alpha and sum(diff) > 0
    return checks | {"promote": better and all(checks.values()), "p_value": p, "statistically_superior": better}


def promotions(models: DataFrame, alpha: float = 0.05, max_latency_ms: float = 200.0, max_ece: float = 0.15) -> DataFrame:
    """models (fold_metrics, champion_metrics, ece, latency_ms) with p_value and promote: many decisions at once, a few folds in each."""

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        paired = [(list(x), list(y)) if x is not None and y is not None else ([], []) for x, y in zip(a, b)]
        return pd.Series([wilcoxon_greater([u - v for u, v in zip(x, y)]) if len(x) == len(y) >= 3 else None for x, y in paired], dtype=float)

    folds, champion = F.col("fold_metrics"), F.col("champion_metrics")
    sound = (F.size(folds) >= 3) & F.forall(folds, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.col("ece") <= max_ece) & (F.col("latency_ms") <= max_latency_ms)
    total = F.aggregate(F.zip_with(folds, champion, lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x)
    df = models.withColumn("p_value", p_value("fold_metrics", "champion_metrics"))
    better = F.coalesce((F.col("p_value") < alpha) & (total > 0), F.lit(False))
    return df.withColumn("promote", F.coalesce(sound & (champion.isNull() | better), F.lit(False)))
