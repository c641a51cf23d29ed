"""Queries that do the whole job: every row, symbol, date or portfolio of their tables."""

import datetime as dt
import math

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import calendar as cal, features, models as ml, portfolio as pf
from barloom.plans import evaluate
from barloom.sources import fixtures as fx, tables

QUERIES = entry.queries()


def test_every_event_has_a_target_session(spark, sf):
    got = {r.event_id: r.target for r in QUERIES["prediction_targets"](spark, sf).collect()}
    events = fx.table(spark, sf, "events").selectExpr("event_id", "cast(ts + interval 2 year + interval 330 minutes as date) as d").collect()
    assert len(got) == len(events) and len(events) > 500
    for r in events:
        d = r.d + dt.timedelta(1)
        while d.weekday() > 4 or d.isoformat() in cal.HOLIDAYS:
            d += dt.timedelta(1)
        assert got[r.event_id] == d


def test_models_learn_from_all_symbols(spark, sf):
    want = {r.symbol for r in features.dataset(fx.bars(spark, sf), "v1").select("symbol").distinct().collect()}
    assert len(want) > 3
    assert {r.symbol for r in evaluate._rows(spark, sf).select("symbol").distinct().collect()} == want
    assert {r.symbol for r in QUERIES["explanation"](spark, sf).collect()} == want


def test_mutual_information_of_all_base_features(spark, sf):
    assert {r.feature for r in QUERIES["mutual_information"](spark, sf).collect()} == set(features.BASE)


def test_walk_forward_makes_every_window_of_every_symbol(spark):
    start = dt.date(2020, 1, 1)
    rows = [(s, start + dt.timedelta(k), float((k * 7 + i) % 5), (k + i) % 2) for i, s in enumerate("ABC") for k in range(100) if s != "C" or k >= 50]
    df = spark.createDataFrame(rows, "symbol string, d date, x double, label int")
    got = ml.walk_forward(df, ["x"], 30, 20, params={"trees": 2, "depth": 2}).collect()
    assert sorted((r.symbol, r.d, r.fold) for r in got) == sorted((s, d, ((d - start).days - 30) // 20) for s, d, _, _ in rows if 30 <= (d - start).days < 90)


def test_walk_forward_query_reaches_the_last_dates(spark, sf):
    rows = evaluate._rows(spark, sf)
    days = sorted(r.d for r in rows.select("d").distinct().collect())
    n = max(0, (len(days) - 252) // 42)
    got = QUERIES["model_walk_forward"](spark, sf).select("symbol", "d").collect()
    want = rows.where(F.col("d").between(days[252], days[252 + n * 42 - 1])).select("symbol", "d").collect()
    assert n > 4 and sorted(got) == sorted(want)


def test_curves_reach_all_dates_without_leaving_a_double(spark, sf):
    bars, sector_bars = fx.bars(spark, sf).count(), fx.sector_bars(spark, sf).count()
    curves = QUERIES["equity_curves_all_dates"](spark, sf).collect()
    assert len(curves) == bars and all(math.isfinite(r.strategy) and math.isfinite(r.hold) for r in curves)
    sectors = QUERIES["sector_features_all_dates"](spark, sf).collect()
    assert len(sectors) == sector_bars and all(r.log_strength_vs_sector is None or math.isfinite(r.log_strength_vs_sector) for r in sectors)


def test_trading_metrics_of_long_histories(spark):
    start, n = dt.date(2000, 1, 1), 3000
    df = spark.createDataFrame([(s, start + dt.timedelta(k), 1, -0.5 if s == "A" or k == 9 else 0.0) for s in "AB" for k in range(n)] + [("C", start, 1, -1.0), ("C", start + dt.timedelta(1), 1, 0.5)], "symbol string, d date, signal int, next_ret double")
    got = {r.symbol: r for r in pf.trading_metrics(df).collect()}
    assert math.isclose(got["A"].annual_return, 0.5**252 - 1) and math.isclose(got["A"].max_drawdown, -1.0)
    assert math.isclose(got["B"].max_drawdown, -0.5) and math.isclose(got["B"].annual_return, 0.5 ** (252 / n) - 1)
    assert got["C"].max_drawdown == -1.0 and got["C"].annual_return is None


def test_stores_hold_all_symbols(spark, sf, monkeypatch):
    paths, shared = {}, tables.shared
    monkeypatch.setattr(tables, "shared", lambda s, name: paths.setdefault(name, shared(s, name)))
    QUERIES["parquet_store"](spark, sf)
    assert spark.read.parquet(paths["bars"]).count() == fx.bars(spark, sf).count()
    QUERIES["feature_store"](spark, sf)
    assert spark.read.parquet(paths["features"]).count() == features.dataset(fx.bars(spark, sf), "v1").count()


def test_every_customer_gets_an_id(spark):
    got = QUERIES["register_all_tickers"](spark, "/root/testdata/sf0.1").collect()
    assert len(got) == fx.table(spark, "/root/testdata/sf0.1", "customer").where("c_custkey > 10").count() == len({r.internal_id for r in got}) > 10_000
