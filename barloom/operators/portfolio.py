"""Holdings, portfolio returns and risk, trading measures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from .ordered import quantiles
from .windows import by, so_far, YEAR, change

ROOT = math.sqrt(YEAR)
#: Portfolios of one block of `yearly`, and those of them that a task multiplies at a time.
BLOCK, AT_ONCE = 16384, 512


def shares_by_symbol(lots: DataFrame, *keys: str) -> DataFrame:
    return lots.groupBy(*keys, "symbol").agg(F.sum("shares").alias("shares"))


def positions(shares: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """With value and weight within keys; all weights are 0 where the total is."""
    df = shares.join(prices.select("symbol", "price"), "symbol").withColumn("value", F.col("shares") * F.col("price"))
    total = F.sum("value").over(Window.partitionBy(*keys))
    return df.withColumn("weight", F.when(total == 0, 0.0).otherwise(F.col("value") / total))


def sector_allocation(weights: DataFrame, sectors: DataFrame, *keys: str) -> DataFrame:
    df = weights.join(sectors.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Unknown")))
    return df.groupBy(*keys, "sector").agg(F.sum("weight").alias("weight"))


def lot_gains(lots: DataFrame, prices: DataFrame) -> DataFrame:
    df = lots.join(prices.select("symbol", "price"), "symbol")
    return df.withColumns({"market_value": F.col("shares") * F.col("price"), "gain_pct": F.when(F.col("avg_cost") != 0, (F.col("price") - F.col("avg_cost")) / F.col("avg_cost"))})


def cumulative(c: Column) -> Column:
    return c / F.first(c).over(so_far()) - 1


def drawdown(df: DataFrame, c: str = "close") -> DataFrame:
    """symbol and its largest fall from the highest value so far."""
    down = F.col(c) / F.max(c).over(so_far()) - 1
    return df.select("symbol", down.alias("x")).groupBy("symbol").agg(F.min("x").alias("max_drawdown"))


def daily_returns(bars: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """Weighted return per date; a symbol without a weight counts 0."""
    r = bars.withColumn("ret", change(F.col("close"))).where("ret is not null").select("symbol", "d", "ret")
    return r.join(weights.select(*keys, "symbol", "weight"), "symbol").groupBy(*keys, "d").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def _moments(x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sum of squared deviations of each row's values where some. Taken from the row's first value: equal values deviate by 0."""
    first = x[np.arange(len(x)), some.argmax(1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.where(some, x - first[:, None], 0.0)
        n = some.sum(1)
        mean = y.sum(1) / n
        return n, first + mean, np.where(some, (y - mean[:, None]) ** 2, 0.0).sum(1)


def _growth(x: np.ndarray) -> np.ndarray:
    """`growth` of an array."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(x <= -1, -np.inf, np.log(1 + x))


_YEARLY = "days long, n long, mean double, squares double, worst double, best double, low_n long, low_mean double, low_squares double, portfolio double, benchmark double"


def _year_of_block(key: str, type_: pa.DataType, year: int, held: pa.Table, returns: pa.Table, at_once: int) -> pa.Table:
    """Rows of `yearly` of one block's portfolios (key, ats, weights) in one year of returns (at, d, ret, benchmark)."""
    schema = pa.schema([(key, type_), ("year", pa.int32())] + [(c, pa.int64() if t == "long" else pa.float64()) for c, t in (x.split() for x in _YEARLY.split(", "))])
    if not held.num_rows or not returns.num_rows:
        return schema.empty_table()
    ats, at = np.unique(returns["at"].to_numpy(), return_inverse=True)
    days, day = np.unique(returns["d"].cast(pa.int32()).to_numpy(), return_inverse=True)
    ret, there, market = np.zeros((len(ats), len(days))), np.zeros((len(ats), len(days)), bool), np.zeros(len(days))
    ret[at, day], there[at, day], market[day] = returns["ret"].to_numpy(), True, returns["benchmark"].to_numpy()
    market = _growth(market)
    sound, whole = np.isfinite(ret).all(1), there.all()
    out = []
    for lo in range(0, held.num_rows, at_once):
        part = held.slice(lo, at_once).combine_chunks()
        lists, values = part["ats"].combine_chunks(), part["weights"].combine_chunks().flatten()
        row, code = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        place = np.searchsorted(ats, code).clip(max=len(ats) - 1)
        known_weight, listed = values.is_valid().to_numpy(zero_copy_only=False), ats[place] == code
        row, place, known_weight, value = row[listed], place[listed], known_weight[listed], values.fill_null(0.0).to_numpy()[listed]
        weight, has, sure = np.zeros((len(lists), len(ats))), np.zeros((len(lists), len(ats)), bool), np.zeros((len(lists), len(ats)), bool)
        np.add.at(weight, (row, place), value)
        has[row, place] = True
        sure[row[known_weight], place[known_weight]] = True
        # a symbol that has an infinite value or NaN is added to the portfolios that hold it, so that 0 times it is no part of others
        plain = sound & np.isfinite(weight).all(0)
        x = np.where(plain, weight, 0.0) @ np.where(plain[:, None], ret, 0.0)
        with np.errstate(invalid="ignore"):
            for s in np.flatnonzero(~plain):
                own = np.flatnonzero(sure[:, s])
                x[own] += np.where(there[s], weight[own, s, None] * ret[s], 0.0)
        meets = lambda a: np.broadcast_to(a.any(1)[:, None], x.shape) if whole else a.astype(np.float32) @ there.astype(np.float32) > 0  # noqa: B023, E731
        seen = meets(has)
        known = seen if known_weight.all() else meets(sure)
        n, mean, squares = _moments(x, known)
        low_n, low_mean, low_squares = _moments(x, known & (x < 0))
        made = [
            seen.sum(1), n, mean, squares, np.where(known, x, np.inf).min(1), np.where(known, x, -np.inf).max(1), low_n, low_mean, low_squares,
            np.where(known, _growth(x), 0.0).sum(1), np.where(seen, market, 0.0).sum(1),
        ]
        none = {"mean": n == 0, "worst": n == 0, "best": n == 0, "low_mean": low_n == 0}
        cols = [pa.array(v, mask=none.get(f.name), type=f.type) for f, v in zip(list(schema)[2:], made)]
        table = pa.table([part[key].cast(type_), pa.array(np.full(len(lists), year), pa.int32()), *cols], schema=schema)
        out.append(table.filter(pa.array(made[0] > 0)))
    return pa.concat_tables(out)


def yearly(bars: DataFrame, weights: DataFrame, key: str, portfolios: int) -> DataFrame:
    """`daily_returns` of many portfolios by key and year: days; n, mean and sum of squared deviations of all returns and of those below 0; worst
    and best; the sums of `growth` of them and of the benchmark, which is the mean return of all symbols.

    Portfolios times dates are far more than rows of either table, and are never rows: a block of portfolios (about how many there are in all
    is `portfolios`) meets the returns of one year, and its daily returns are the product of both matrices, a few portfolios at a time. The
    shuffle has each portfolio once for each year and the symbols' returns once for each block.
    """
    spark = bars.sparkSession
    r = bars.withColumn("ret", change(F.col("close"))).where("ret is not null").select("symbol", "d", "ret")
    path = tables.shared(spark, "returns")
    r.withColumn("benchmark", F.avg("ret").over(Window.partitionBy("d"))).write.parquet(path)
    r = spark.read.parquet(path).withColumn("year", F.year("d"))
    symbols = r.select("symbol").distinct().withColumn("at", F.row_number().over(Window.partitionBy().orderBy("symbol")))  # one row per symbol
    blocks = 1 + portfolios // BLOCK
    held = weights.select(key, "symbol", "weight").join(F.broadcast(symbols), "symbol").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("h"))
    held = held.select(key, F.col("h.at").alias("ats"), F.col("h.weight").alias("weights"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"))
    held = held.join(F.broadcast(r.select("year").distinct()))
    dealt = r.join(F.broadcast(symbols), "symbol").select("at", "d", "ret", "benchmark", "year", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    type_ = weights.schema[key].dataType
    arrow = spark.createDataFrame([], weights.select(key).schema).toArrow().schema.field(0).type
    at_once = AT_ONCE
    run = lambda k, a, b: _year_of_block(key, arrow, k[1].as_py(), a, b, at_once)
    return held.groupBy("block", "year").cogroup(dealt.groupBy("block", "year")).applyInArrow(run, f"`{key}` {type_.simpleString()}, year int, {_YEARLY}")


def deviation(n: Column, squares: Column) -> Column:
    """stddev_samp by the number of values and the sum of squared deviations."""
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def whole_history(years: DataFrame, key: str) -> DataFrame:
    """n, mean and squares of all years of `yearly`, and low_n, low_mean and low_squares, by key."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def added(a: Column, x: Column) -> Column:
        n, gap = a["n"] + x["n"], x["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + gap * x["n"] / n).alias("mean"), (a["squares"] + x["squares"] + gap * gap * a["n"] * x["n"] / n).alias("squares"))
        return F.when(x["n"] == 0, a).when(a["n"] == 0, x).otherwise(both)

    parts = [F.array_sort(F.collect_list(F.struct("year", F.struct(F.col(f"{p}n").alias("n"), F.col(f"{p}mean").alias("mean"), F.col(f"{p}squares").alias("squares")).alias("m")))) for p in ("", "low_")]  # a row for each year
    out = years.groupBy(key).agg(*(F.aggregate(F.transform(c, lambda x: x["m"]), start, added).alias(a) for c, a in zip(parts, ("all", "low"))))
    return out.select(key, "all.*", *(F.col(f"low.{c}").alias(f"low_{c}") for c in ("n", "mean", "squares")))


def sharpe(c: str = "ret", free: float = 0.0) -> Column:
    return sharpe_of(F.count(c), F.avg(c), F.stddev_samp(c), free)


def sharpe_of(n: Column, mean: Column, dev: Column, free: float = 0.0) -> Column:
    return F.when(n == 0, 0.0).when(dev == 0, 0.0).otherwise((mean - free / YEAR) / dev * ROOT)


def sortino(c: str = "ret") -> Column:
    return sortino_of(F.avg(c), F.stddev_samp(F.when(F.col(c) < 0, F.col(c))))


def sortino_of(mean: Column, low: Column) -> Column:
    return F.coalesce(mean / F.nullif(low, F.lit(0.0)) * ROOT, F.lit(0.0))


def yearly_volatility(c: str = "ret") -> Column:
    return F.stddev_samp(c) * ROOT


def risk_level(v: Column) -> Column:
    return F.when(v < 0.15, "Low").when(v < 0.30, "Medium").when(v.isNotNull(), "High")


def diversification(w: str = "weight") -> Column:
    """round((1 - sum of squares) * 100, 1, half to even) over positive weights; 0 if there are none."""
    return F.bround(F.coalesce((1 - F.sum(F.when(F.col(w) > 0, F.col(w) * F.col(w)))) * 100, F.lit(0.0)), 1)


def equity(df: DataFrame, signal: str = "signal", ret: str = "next_ret") -> DataFrame:
    """Strategy and buy-and-hold curves; a missing return is 0."""
    both = {"strategy": F.col(ret) * F.col(signal), "hold": F.col(ret)}
    return df.withColumns({k: F.product(1 + F.coalesce(v, F.lit(0.0))).over(so_far()) for k, v in both.items()})


def growth(ret: Column) -> Column:
    """ln(1 + ret): 0 for a missing return, minus infinity where all is lost."""
    x = 1 + F.coalesce(ret, F.lit(0.0))
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def log_equity(df: DataFrame, signal: str = "signal", ret: str = "next_ret") -> DataFrame:
    """Logs of both curves. Sums stay within a double's range where the products of a long history don't."""
    both = {"strategy": F.col(ret) * F.col(signal), "hold": F.col(ret)}
    return df.withColumns({k: F.sum(growth(v)).over(so_far()) for k, v in both.items()})


def trading_metrics(df: DataFrame) -> DataFrame:
    """Per symbol, of a long or flat signal (signal, next_ret): eleven measures. No losses but gains: infinite profit factor."""
    r, s = F.col("next_ret") * F.col("signal"), F.col("signal")
    df = log_equity(df).withColumn("r", r)
    lost = F.col("strategy") == float("-inf")
    down = F.when(lost, -1.0).otherwise(F.exp(F.col("strategy") - F.max("strategy").over(so_far())) - 1)
    df = df.withColumns({"down": down, "turn": (F.coalesce(s - F.lag("signal").over(by()), F.lit(0)) != 0).cast("int")})
    trade = s == 1
    gain, loss = F.when(trade & (F.col("r") > 0), F.col("r")), F.when(trade & (F.col("r") < 0), F.col("r"))
    out = df.groupBy("symbol").agg(
        sharpe("r").alias("sharpe"), sortino("r").alias("sortino"), F.sum(gain).alias("g"), F.sum(loss).alias("l"), F.min("down").alias("max_drawdown"), F.try_divide(F.count(gain), F.count_if(trade)).alias("win_rate"),
        F.coalesce(F.avg(gain), F.lit(0.0)).alias("avg_gain"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.max_by("strategy", "d").alias("final"), F.count("*").alias("n"), F.coalesce(yearly_volatility("r"), F.lit(0.0)).alias("volatility"),
        (F.sum("turn") / F.count("*")).alias("turnover"),
    )
    year = F.when(F.col("final") > float("-inf"), F.exp(F.col("final") * YEAR / F.col("n")) - 1)
    factor = F.when(F.coalesce("l", F.lit(0.0)) != 0, F.coalesce("g", F.lit(0.0)) / F.abs("l")).when(F.col("g") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.select("symbol", "sharpe", "sortino", (year / F.abs(F.nullif("max_drawdown", F.lit(0.0)))).alias("calmar"), factor.alias("profit_factor"), "max_drawdown", "win_rate", "avg_gain", "avg_loss", year.alias("annual_return"), "volatility", "turnover")


def monte_carlo(returns: DataFrame, initial: float = 100_000.0, horizon: int = 252, sims: int = 500, seed: int = 42) -> DataFrame:
    """sim, step, value: bootstrapped paths; step 0 is the initial value. Draws are MD5 hashes of (seed, sim, step), so a lost task redraws the same.

    The history of one portfolio (a return per date) is one array row, joined to the draws.
    """
    spark = returns.sparkSession
    hist = returns.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "ret"))), lambda x: x["ret"]).alias("h"))
    draws = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("step"))
    drawn = F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("step").cast("string"))), F.lit(1), F.lit(12))
    pick = F.pmod(F.conv(drawn, 16, 10).cast("long"), F.size("h").cast("long")).cast("int")
    df = draws.join(F.broadcast(hist)).select("sim", "step", F.when(F.col("step") == 0, 1.0).otherwise(1 + F.get("h", pick)).alias("x"))
    return df.select("sim", "step", (initial * F.product("x").over(Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).alias("value"))


def path_percentiles(paths: DataFrame) -> DataFrame:
    """step, p5, p50, p95 of the paths' values."""
    q = F.col("q")
    return quantiles(paths, "value", [0.05, 0.5, 0.95], "step").select("step", q[0].alias("p5"), q[1].alias("p50"), q[2].alias("p95"))


def recent_swings(bars: DataFrame, n: int = 60) -> DataFrame:
    """Largest fall and rise within the last n rows of each symbol; 0 with fewer than 5."""
    late = bars.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))).where(f"r <= {n}")
    c = F.col("close")
    late = late.withColumns({"down": (c - F.max(c).over(so_far())) / F.max(c).over(so_far()), "up": (c - F.min(c).over(so_far())) / F.min(c).over(so_far())})
    few = F.count("*") < 5
    return late.groupBy("symbol").agg(F.when(few, 0.0).otherwise(F.min("down")).alias("expected_drawdown"), F.when(few, 0.0).otherwise(F.max("up")).alias("expected_upside"))
