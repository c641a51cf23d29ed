"""Model training and the evaluation loops over folds, with pyspark.ml. Training is the one eager part of the library."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import boosting, evaluation as ev, ordered, tpe, trees
from .crosssection import label_correlation, top_fraction
from .ordered import neighbour_information

SEED = 42
#: Models that the driver fits at a time.
FITS = 4
#: Families that pyspark.ml fits, by their parameters.
FAMILIES = {
    "random_forest": lambda p: RandomForestClassifier(numTrees=int(p.get("trees", 100)), maxDepth=int(p.get("depth", 6)), seed=SEED),
    "gradient_boosting": lambda p: GBTClassifier(maxIter=int(p.get("trees", 20)), maxDepth=int(p.get("depth", 4)), stepSize=p.get("step", 0.1), seed=SEED),
    "logistic": lambda p: LogisticRegression(regParam=p.get("reg", 0.01)),
}
#: Families that differ in how a tree grows: one split for each level, or the best leaf first.
BOOSTED = {
    "oblivious_boosting": lambda p: boosting.Params(trees=int(p.get("trees", 30)), depth=int(p.get("depth", 6)), step=p.get("step", 0.05), oblivious=True),
    "leafwise_boosting": lambda p: boosting.Params(trees=int(p.get("trees", 30)), leaves=2 ** int(p.get("depth", 5)) - 1, step=p.get("step", 0.1), oblivious=False),
}
Model = PipelineModel | trees.Ensemble


def fit(family: str, params: dict, rows: DataFrame, names: list[str]) -> Model:
    if family in BOOSTED:
        return boosting.fit(rows, names, BOOSTED[family](params))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"), FAMILIES[family](params)]).fit(rows.withColumn("label", F.col("label").cast("double")))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """rows with probability, predicted and actual."""
    drop = [c for c in ("features", "rawPrediction", "prediction") if c not in rows.columns]
    out = model.transform(rows) if isinstance(model, trees.Ensemble) else model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return out.withColumns({"predicted": (F.col("probability") >= 0.5).cast("int"), "actual": F.col("label").cast("int")}).drop(*drop)


def ensemble(predictions: DataFrame, *keys: str) -> DataFrame:
    """Mean probability of several models' rows, up from 0.5 on."""
    return predictions.groupBy(*keys).agg(F.avg("probability").alias("probability")).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


def naive(features: DataFrame) -> DataFrame:
    """The direction of the last return is expected to last."""
    return features.withColumns({"predicted": F.when(F.col("lag_return_1") > 0, 1).otherwise(0), "actual": F.col("label").cast("int")})


def folds(rows: DataFrame, n: int = 5) -> list[tuple]:
    return [(r["fold"], r["train_end"], r["val_start"], r["val_end"]) for r in ev.expanding_folds(rows, n).orderBy("fold").collect()]


def fold_scores(family: str, params: dict, rows: DataFrame, names: list[str], spans: list[tuple]) -> list[dict]:
    """Metrics of each fold, trained on all dates up to its train end."""
    out = []
    for fold, end, start, stop in spans:
        model = fit(family, params, rows.where(F.col("d") <= F.lit(end)), names)
        row = ev.classification(predict(model, rows.where(F.col("d").between(start, stop)))).first()
        out.append({"fold": fold, **(row.asDict() if row else {})})
    return out


def fold_summary(scores: DataFrame, metric: str) -> DataFrame:
    """Mean and population deviation, missing values left out."""
    return scores.agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(metric).alias("n"))


def walk_forward(rows: DataFrame, names: list[str], train: int = 252, test: int = 21, family: str = "random_forest", params: dict | None = None, expanding: bool = False, step: int | None = None) -> DataFrame:
    """Predictions of all test windows of the rows of one symbol or many, by position of the date among all dates; the window moves by `step` dates (the test length).

    A model learns from every symbol's rows of its training dates. The models don't depend on each other, so several are fitted at a time.
    """
    spark = rows.sparkSession
    w = Window.partitionBy().orderBy("d")  # one row per date
    days = rows.select("d").distinct().withColumn("pos", F.row_number().over(w) - 1)
    path = tables.shared(spark, "windows")
    rows.join(F.broadcast(days), "d").select(*rows.columns, "pos").write.parquet(path)
    rows = spark.read.parquet(path)
    n = rows.agg(F.max("pos")).first()[0]

    def window(k: int, start: int) -> DataFrame:
        lo = 0 if expanding else start
        model = fit(family, params or {}, rows.where(f"pos >= {lo} and pos < {start + train}"), names)
        return predict(model, rows.where(f"pos >= {start + train} and pos < {start + train + test}")).withColumn("fold", F.lit(k))

    starts = range(0, (n + 1 if n is not None else 0) - train - test + 1, step or test)
    with ThreadPool(FITS) as pool:
        parts = pool.starmap(inheritable_thread_target(spark)(window), enumerate(starts))
    return functools.reduce(DataFrame.unionByName, parts) if parts else rows.limit(0).withColumns({"probability": F.lit(0.0), "predicted": F.lit(0), "actual": F.lit(0), "fold": F.lit(0)})


def rolling_origin(rows: DataFrame, names: list[str], least: int, step: int = 5, family: str = "random_forest", params: dict | None = None) -> DataFrame:
    """One date ahead, from every `step`-th origin, learning from all dates before it."""
    return walk_forward(rows, names, least, 1, family, params, expanding=True, step=step)


#: What a search varies, by family.
SPACES: dict[str, tpe.Space] = {
    "logistic": {"reg": tpe.Span(1e-4, 1.0, log=True)},
    "random_forest": {"trees": tpe.Span(10, 80, log=True, whole=True), "depth": tpe.Span(2, 8, whole=True)},
    **{k: {"trees": tpe.Span(5, 60, log=True, whole=True), "depth": tpe.Span(2, 6, whole=True), "step": tpe.Span(0.02, 0.4, log=True)} for k in ("gradient_boosting", *BOOSTED)},
}


def tune(family: str, rows: DataFrame, names: list[str], trials: int = 10, n_folds: int = 5, metric: str = "roc_auc", seed: int = SEED) -> tuple[dict, list[dict]]:
    """Seeded search by Parzen estimators; the best parameters and a log of every trial."""
    rng, spans, log = random.Random(seed), folds(rows, n_folds), []
    for trial in range(trials):
        params = tpe.suggest(SPACES[family], [(t["params"], t[metric]) for t in log], rng)
        scores = fold_scores(family, params, rows, names, spans)
        got = [s[metric] for s in scores if s.get(metric) is not None]
        log.append({"family": family, "trial": trial, "params": params, "fold_metrics": got, metric: sum(got) / len(got) if got else None})
    return max(log, key=lambda t: (t[metric] is not None, t[metric] or 0.0))["params"], log


def nested_cv(rows: DataFrame, names: list[str], family: str = "random_forest", outer: int = 3, trials: int = 5, inner: int = 3) -> list[dict]:
    """Each outer fold is scored with the parameters that its own training dates choose."""
    out = []
    for fold, end, start, stop in folds(rows, outer):
        best, _ = tune(family, rows.where(F.col("d") <= F.lit(end)), names, trials, inner)
        out += fold_scores(family, best, rows, names, [(fold, end, start, stop)])
    return out


def calibrate(preds: DataFrame, test: DataFrame) -> DataFrame:
    """method, brier, ece, mce of raw, temperature, Platt and isotonic probabilities on test; fitted on preds."""
    t = ev.fit_temperature(preds)
    z = lambda df: df.withColumns({"label": F.col("actual").cast("double"), "logit": F.ln(F.greatest(F.col("probability"), F.lit(1e-12)) / F.greatest(1 - F.col("probability"), F.lit(1e-12)))})
    lr = Pipeline(stages=[VectorAssembler(inputCols=["logit"], outputCol="x"), LogisticRegression(featuresCol="x", probabilityCol="q")]).fit(z(preds))
    iso = Pipeline(stages=[VectorAssembler(inputCols=["probability"], outputCol="x"), IsotonicRegression(featuresCol="x")]).fit(z(preds))
    made = {
        "raw": test, "temperature": test.withColumn("probability", ev.apply_temperature(F.col("probability"), t)), "platt": lr.transform(z(test)).withColumn("probability", vector_to_array("q")[1]).select(*test.columns),
        "isotonic": iso.transform(z(test)).withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).select(*test.columns),
    }
    parts = [df.agg(F.avg(F.pow(F.col("probability") - F.col("actual"), 2)).alias("brier")).join(ev.calibration_error(df)).select(F.lit(k).alias("method"), "brier", "ece", "mce") for k, df in made.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def importance(model: Model, names: list[str]) -> dict[str, float]:
    if isinstance(model, trees.Ensemble):
        return model.importance()
    return dict(zip(names, [float(x) for x in model.stages[-1].featureImportances.toArray()]))


def importance_stability(rows: DataFrame, names: list[str], n_folds: int = 5, family: str = "random_forest") -> DataFrame:
    """feature, mean, std, cv of importances over folds."""
    spark, got = rows.sparkSession, []
    for fold, end, _, _ in folds(rows, n_folds):
        got += [(fold, k, v) for k, v in importance(fit(family, {"trees": 20, "depth": 4}, rows.where(F.col("d") <= F.lit(end)), names), names).items()]
    df = spark.createDataFrame(got, "fold int, feature string, value double")
    return df.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


def permutation_importance(model: Model, rows: DataFrame, names: list[str], repeats: int = 3) -> DataFrame:
    """feature, drop in accuracy when its values are dealt anew by a seeded order."""
    acc = lambda df: predict(model, df).agg(F.avg((F.col("predicted") == F.col("actual")).cast("double"))).first()[0]
    path = tables.shared(rows.sparkSession, "permuted")
    rows.withColumn("_i", F.row_number().over(Window.partitionBy("symbol").orderBy("d"))).write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    base, out = acc(rows), []
    for name in names:
        drops = []
        for k in range(repeats):
            dealt = rows.select("symbol", F.col(name).alias("_v"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.xxhash64("d", F.lit(SEED + k)))).alias("_i"))
            drops.append(base - acc(rows.drop(name).join(dealt, ["symbol", "_i"]).withColumnRenamed("_v", name)))
        out.append((name, sum(drops) / repeats))
    return rows.sparkSession.createDataFrame(out, "feature string, importance double")


def mutual_information(rows: DataFrame, names: list[str], label: str = "label", k: int = 3) -> DataFrame:
    """feature, mi: by nearest neighbours."""
    return neighbour_information(rows, names, label, k)


def weak_features(scores: DataFrame, least_mi: float = 0.001, fraction: float = 0.5) -> DataFrame:
    """scores (feature, mi, importance): those of little information in the lower part by importance."""
    w = Window.partitionBy()  # a row for each feature
    return scores.withColumns({"rank": F.row_number().over(w.orderBy("importance", "feature")), "n": F.count("*").over(w)}).where((F.col("mi") < least_mi) & (F.col("rank") <= F.floor(F.col("n") * fraction))).select("feature", "mi", "importance")


def normal(seed: int, *keys: Column) -> Column:
    """A normal draw that follows from its keys alone: two hashes, by Box and Muller. A task that runs again draws the same."""
    even = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.ln(even(0))) * F.cos(2 * math.pi * even(1))


def stability(model: Model, rows: DataFrame, names: list[str], trials: int = 20, noise: float = 0.05, keys: tuple[str, ...] = ("symbol", "d")) -> DataFrame:
    """keys, probability, probability_std, stability (0 to 100): how little a row's probability moves when its features are shaken by noise times their size."""
    shaken = rows.select(*keys, *names, F.explode(F.sequence(F.lit(0), F.lit(trials))).alias("trial"))
    at = [F.col(k) for k in (*keys, "trial")]
    shaken = shaken.withColumns({n: F.when(F.col("trial") == 0, F.col(n)).otherwise(F.col(n) + noise * (F.abs(F.col(n)) + 1e-6) * normal(SEED, F.lit(n), *at)) for n in names})  # trial 0 is the row itself
    p = predict(model, shaken.withColumn("label", F.lit(0.0)))
    spread = F.coalesce(F.stddev_pop(F.when(F.col("trial") > 0, F.col("probability"))), F.lit(0.0))
    out = p.groupBy(*keys).agg(F.max(F.when(F.col("trial") == 0, F.col("probability"))).alias("probability"), spread.alias("probability_std"))
    return out.withColumn("stability", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("probability_std") / 0.25 * 100)))


def bundle(family: str, params: dict, rows: DataFrame, names: list[str], n_folds: int = 3, metric: str = "roc_auc", top: int = 10) -> DataFrame:
    """section, item, value of one model version: metrics and confusion cells of held-out dates, the metric of each expanding fold (the learning
    curve), importances, mean absolute attributions over all held-out rows, features that leak, and those of them among the top attributions."""
    spark = rows.sparkSession
    parts = ev.chronological_split(rows, 0.7, 0.15)
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    model = fit(family, params, train, names)
    scored = predict(model, test)
    metrics = ev.classification(scored)
    out = metrics.unpivot([], metrics.columns, "item", "value").select(F.lit("metric").alias("section"), "item", F.col("value").cast("double").alias("value"))
    cells = ev.confusion(scored)
    out = out.unionByName(cells.select(F.lit("confusion").alias("section"), F.concat(F.lit("n_"), F.col("actual").cast("string"), F.col("predicted").cast("string")).alias("item"), F.col("n").cast("double").alias("value")))
    curve = [("learning_curve", str(s["fold"]), s.get(metric)) for s in fold_scores(family, params, train, names, folds(train, n_folds))]
    weights = [("importance", k, float(v)) for k, v in importance(model, names).items()]
    impact = {r["feature"]: r["v"] for r in explain(model, test, names, None).groupBy("feature").agg(F.avg(F.abs("effect")).alias("v")).collect()}  # a row for each feature
    leaks = {r["feature"] for r in label_correlation(train, names).where("leak").collect()}
    first = sorted(impact, key=lambda k: (-impact[k], k))[:top]
    rest = [("attribution", k, float(v)) for k, v in impact.items()] + [("leak", k, 1.0) for k in sorted(leaks)] + [("leak_in_top", k, 1.0) for k in first if k in leaks]
    return out.unionByName(spark.createDataFrame(curve + weights + rest, "section string, item string, value double"))


def explain(model: Model, rows: DataFrame, names: list[str], top: int | None = 5) -> DataFrame:
    """symbol, d, prediction, base, feature, effect, rank: what each feature adds to a row's prediction, by the model's trees.

    Effects of a forest are in its probability, those of boosted trees in the log of odds."""
    ensemble = model if isinstance(model, trees.Ensemble) else trees.of_forest(rows.sparkSession, model.stages[-1], names)
    return ensemble.explain(rows, top=top)


def compare_labels(candidates: dict[str, DataFrame], names: list[str], least: int = 100) -> list[dict]:
    """Held-out metrics of a small forest for each label candidate, 70/30 by date; those with too few rows are left out."""
    out = []
    for k, df in candidates.items():
        df = df.na.drop(subset=[*names, "label"])
        if df.limit(least).count() < least:
            continue
        part = ev.chronological_split(df, 0.7, 0.0)
        model = fit("random_forest", {"trees": 20, "depth": 4}, part.where("part = 'train'"), names)
        out.append({"label": k, **ev.classification(predict(model, part.where("part = 'test'"))).first().asDict()})
    return out


def corrections(family: str, params: dict) -> list[dict]:
    """Attempts after a failed gate: shallower, fewer features, smaller steps."""
    return [{**params, "depth": max(2, int(params.get("depth", 6)) - 2)}, {**params, "keep_fraction": 0.6}, {**params, "step": params.get("step", 0.1) / 2}]


def attempt_corrections(family: str, params: dict, parts: DataFrame, names: list[str]) -> list[dict]:
    """The first model and up to three corrected ones, until one passes the gate. parts: rows with column part (train, val).

    A fit passes if its AUC on validation dates is within a fifth of that on training dates."""
    train, val = (parts.where(F.col("part") == p).drop("part") for p in ("train", "val"))
    out = []
    for k, p in enumerate([params, *corrections(family, params)]):
        keep = p.get("keep_fraction")
        used = names if keep is None else [r["feature"] for r in top_fraction(label_correlation(train, names), keep).collect()]
        model = fit(family, p, train, used)
        a, b = (ev.classification(predict(model, x)).first()["roc_auc"] for x in (train, val))
        gate = a is not None and b is not None and a > 0 and abs(a - b) / a <= 0.2
        out.append({"attempt": k, "change": json.dumps(p, sort_keys=True), "train_auc": a, "val_auc": b, "passed": gate})
        if gate:
            break
    return out


def compare_windows(rows: DataFrame, names: list[str], configs: list[tuple[int, int]], family: str = "random_forest", params: dict | None = None) -> DataFrame:
    """kind (rolling, expanding), train, test, folds, n, accuracy of walk-forward predictions for each configuration."""
    out = None
    for train, test in configs:
        for kind in ("rolling", "expanding"):
            got = walk_forward(rows, names, train, test, family, params, expanding=kind == "expanding")
            row = got.agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"))
            row = row.select(F.lit(kind).alias("kind"), F.lit(train).alias("train"), F.lit(test).alias("test"), "*")
            out = row if out is None else out.unionByName(row)
    return out


@dataclass
class Registry:
    """Versions of models as rows, one of a name active: the newest registered as such."""

    rows: list[dict] = field(default_factory=list)

    def register(self, name: str, version: str, metrics: dict, activate: bool = True) -> dict:
        if activate:
            for r in self.rows:
                r["is_active"] = r["is_active"] and r["model_name"] != name
        row = {"id": len(self.rows) + 1, "model_name": name, "version": version, "metrics_json": json.dumps(metrics, sort_keys=True), "is_active": activate}
        self.rows.append(row)
        return row

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "id int, model_name string, version string, metrics_json string, is_active boolean")


def code_hash(*functions) -> str:
    """SHA-256 over the sources of functions, for versions of features."""
    import inspect

    return hashlib.sha256("".join(inspect.getsource(f) for f in functions).encode()).hexdigest()


def recommendation(p: DataFrame) -> DataFrame:
    """stance and risks of predictions (probability, confidence_level, drift_status, freshness, risk_level, expected_drawdown, expected_upside)."""
    up = F.col("probability") >= 0.5
    risks = F.array_compact(F.array(
        F.when(F.col("risk_level").isNull(), "no risk assessment").otherwise(F.concat(F.col("risk_level"), F.lit(" risk"))), F.when(F.col("drift_status") == "Significant Drift", "live drift"),
        F.when(F.col("freshness").isin("Stale", "Unknown"), "old data"), F.when(F.col("confidence_level").isin("Low", "Very Low"), "near a coin flip"),
    ))
    level: Column = F.when(up, F.col("expected_drawdown")).otherwise(F.col("expected_upside"))
    return p.withColumns({"stance": F.when(up, "Leans Up").otherwise("Leans Down"), "reference_level": level, "key_risks": F.array_join(risks, "; ")})
