"""Years of many portfolios by blocks against daily returns, row by row."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.operators import portfolio as pf
from barloom.operators.windows import change


@pytest.fixture(scope="module")
def market(spark):
    """Bars with gaps, a symbol with one bar, one that loses all and one that is infinite once; weights with NULL, twice a symbol, symbols without bars."""
    rng = random.Random(5)
    start, bars = dt.date(2019, 11, 1), []
    for i, s in enumerate(["A", "B", "C", "D", "flat", "dead", "huge", "once"]):
        close = 100.0
        for k in range(150):
            if rng.random() < 0.3 or s == "once" and bars and bars[-1][0] == s:
                continue
            close = {"flat": 7.0, "dead": 0.0 if k > 100 else 5.0, "huge": math.inf if k == 90 else 3.0}.get(s, close * rng.uniform(0.9, 1.12))
            bars.append((s, start + dt.timedelta(k + i), close))
    names = ["A", "B", "C", "D", "flat", "dead", "huge", "once", "unlisted"]
    weights = [(p if p else None, rng.choice(names), rng.choice([0.0, None, *(rng.uniform(-0.5, 1.5) for _ in range(8))])) for p in range(60) for _ in range(rng.randint(1, 4))]
    weights += [(100, "flat", 1.0), (101, "once", 1.0), (102, "unlisted", 1.0), (103, "dead", 1.0), (104, "A", None), (105, "huge", 1.0)]
    return spark.createDataFrame(bars, "symbol string, d date, close double"), spark.createDataFrame(weights, "p long, symbol string, weight double")


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("block, at_once", [(16384, 512), (7, 3)])
def test_years_of_blocks_equal_daily_rows(spark, market, monkeypatch, block, at_once):
    monkeypatch.setattr(pf, "BLOCK", block)
    monkeypatch.setattr(pf, "AT_ONCE", at_once)
    bars, weights = market
    daily = pf.daily_returns(bars, weights, "p").withColumn("year", F.year("d")).cache()
    mean = bars.withColumn("ret", change(F.col("close"))).where("ret is not null").groupBy("d").agg(F.avg("ret").alias("b"))
    low = F.when(F.col("ret") < 0, F.col("ret"))
    names = ["days", "n", "mean", "deviation", "worst", "best", "low_n", "low_mean", "low_deviation", "portfolio", "benchmark"]
    want = daily.join(mean, "d").groupBy("p", "year").agg(
        F.count("*").alias("days"), F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("deviation"), F.min("ret").alias("worst"), F.max("ret").alias("best"),
        F.count(low).alias("low_n"), F.avg(low).alias("low_mean"), F.stddev_samp(low).alias("low_deviation"), F.sum(pf.growth(F.col("ret"))).alias("portfolio"), F.sum(pf.growth(F.col("b"))).alias("benchmark"),
    )
    years = pf.yearly(bars, weights, "p", 60).cache()
    got = years.withColumns({"deviation": pf.deviation(F.col("n"), F.col("squares")), "low_deviation": pf.deviation(F.col("low_n"), F.col("low_squares"))})
    got, want = ({(r.p, r.year): r for r in x.collect()} for x in (got, want))
    assert set(got) == set(want) and len(want) > 100 and (None, 2020) in want and (102, 2020) not in want
    for k, r in want.items():
        assert all(same(got[k][c], r[c]) for c in names), (k, got[k], r)

    m = {r.p: r for r in pf.whole_history(years, "p").select("p", "n", "mean", "low_n", pf.deviation(F.col("n"), F.col("squares")).alias("deviation"), pf.deviation(F.col("low_n"), F.col("low_squares")).alias("low_deviation")).collect()}
    all_ = {r.p: r for r in daily.groupBy("p").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.count(low).alias("low_n"), F.stddev_samp("ret").alias("deviation"), F.stddev_samp(low).alias("low_deviation")).collect()}
    assert set(m) == set(all_)
    for p, r in all_.items():
        assert all(same(m[p][c], r[c]) for c in ("n", "low_n", "deviation", "low_deviation")) and (r.n == 0 or same(m[p]["mean"], r["mean"])), (p, m[p], r)


@pytest.mark.parametrize("name", ["portfolio_risk", "portfolio_yearly_returns", "portfolios_vs_benchmark"])
def test_portfolios_times_dates_are_never_rows(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [portfolio_id" in plan
    assert not [line for line in plan.splitlines() if "Aggregate [portfolio_id" in line and ", d#" in line.split("]")[0]]
