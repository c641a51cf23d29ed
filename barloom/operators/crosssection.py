"""Statistics across symbols: breadth on the grid of all dates, sector composites, correlations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as ind, ordered
from .portfolio import growth
from .windows import by, so_far, YEAR, change, last, rolling

def by_date():
    """One row per trading date: thousands, however many symbols there are."""
    return Window.partitionBy().orderBy("d")


def grid(bars: DataFrame) -> DataFrame:
    """Every symbol on every date that any symbol has; NULL where it has no bar."""
    # dates and symbols are small dimensions; their product is the dense panel itself
    return bars.select("d").distinct().join(bars.select("symbol").distinct()).join(bars, ["symbol", "d"], "left")


def breadth(bars: DataFrame) -> DataFrame:
    """Per date: universe, advances over declines, new highs and lows, shares above three averages, composite momentum, participation."""
    emas = ["ema_20", "ema_50", "ema_200"]
    own = ind.smoothed(bars.select("symbol", "d", "close"), *emas).select("symbol", "d", *emas)
    g = grid(bars.select("symbol", "d", "close")).withColumn("ret", change(F.col("close")))
    c = F.col("close")
    g = g.withColumns({"hi": rolling(F.max, c, YEAR, 20), "lo": rolling(F.min, c, YEAR, 20)}).join(own, ["symbol", "d"], "left")
    n = F.count("close")
    day = g.groupBy("d").agg(
        n.alias("universe_size"), F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"), F.count_if(c >= F.col("hi")).alias("new_highs"), F.count_if(c <= F.col("lo")).alias("new_lows"),
        *((F.count_if(c > F.col(e)) / n).alias(f"pct_above_{e.replace('_', '')}") for e in emas), F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mean_ret"),
    )
    day = day.withColumn("composite", F.product(1 + F.col("mean_ret")).over(by_date().rowsBetween(Window.unboundedPreceding, 0)))
    return day.select(
        "d", "universe_size", (F.col("up") / F.nullif("down", F.lit(0))).alias("advance_decline_ratio"), "new_highs", "new_lows", "pct_above_ema20", "pct_above_ema50", "pct_above_ema200",
        (F.col("composite") / F.lag("composite", 20).over(by_date()) - 1).alias("market_momentum_20"), (F.col("up") / F.col("universe_size")).alias("market_participation"),
    )


def peers(bars: DataFrame) -> DataFrame:
    """symbol, peer: other symbols of its sector. A dimension join; prices aren't touched."""
    dim = bars.select("symbol", "sector").where("sector is not null").distinct()
    return dim.join(dim.withColumnsRenamed({"symbol": "peer"}), "sector").where("symbol <> peer").select("symbol", "sector", "peer")


def sector_logs(bars: DataFrame, least: int = 2) -> DataFrame:
    """bars' keys with six features against the mean of the other symbols of the sector; NULL with fewer peers than `least`.

    A peer mean is the sector's sum without the symbol's own part, so no pair of symbols is joined on dates.
    """
    c = F.col("close")
    df = bars.select("symbol", "sector", "d", "close").withColumn("ret", change(c)).withColumn("above", F.coalesce(c > rolling(F.avg, c, 20), F.lit(False)).cast("double"))
    day = df.groupBy("sector", "d").agg(F.sum("ret").alias("s"), F.count("ret").alias("n"), F.sum("above").alias("a"), F.count("above").alias("m"))
    size = df.select("sector", "symbol").distinct().groupBy("sector").agg((F.count("*") - 1).alias("others"))
    own, mine = F.coalesce("ret", F.lit(0.0)), F.col("ret").isNotNull().cast("int")
    df = df.join(day, ["sector", "d"]).join(size, "sector")
    df = df.withColumns({
        "sector_ret": F.when((F.col("others") >= least) & (F.col("n") - mine > 0), (F.col("s") - own) / (F.col("n") - mine)),
        "sector_breadth": F.when((F.col("others") >= least) & (F.col("m") > 1), (F.col("a") - F.col("above")) / (F.col("m") - 1)),
    })
    enough = F.col("others") >= least
    # sums of logs: the products of a long history leave a double's range
    cum = lambda x: F.sum(growth(x)).over(so_far())
    df = df.withColumns({"si": F.when(enough, cum("sector_ret")), "xi": cum("ret")})
    df = df.withColumn("frame", F.collect_list("si").over(last(20)))
    mean = F.aggregate(F.transform("frame", lambda x: F.exp(x - F.col("si"))), F.lit(0.0), lambda a, x: a + x) / 20
    return df.select(
        "symbol", "sector", "d", (F.col("xi") - F.col("si")).alias("log_strength_vs_sector"), (F.col("ret") - F.col("sector_ret")).alias("excess_return_vs_sector"),
        (F.col("si") - F.lag("si", 20).over(by())).alias("log_momentum_20"), (rolling(F.stddev_samp, F.col("sector_ret"), 20) * math.sqrt(YEAR)).alias("sector_volatility_20"),
        F.when(F.size("frame") == 20, 1 / mean - 1).alias("sector_trend"), "sector_breadth",
    )


def sector_relative(bars: DataFrame, least: int = 2) -> DataFrame:
    """sector_logs with its two logs as a ratio and a return."""
    df = sector_logs(bars, least)
    return df.select(
        "symbol", "sector", "d", F.exp("log_strength_vs_sector").alias("relative_strength_vs_sector"), "excess_return_vs_sector", (F.exp("log_momentum_20") - 1).alias("sector_momentum_20"),
        "sector_volatility_20", "sector_trend", "sector_breadth",
    )


#: Symbols of a column block of the return matrix.
GRAM = 256


def correlation_matrix(bars: DataFrame, width: int = GRAM) -> DataFrame:
    """a, b, corr of daily returns on shared dates, in both orders.

    Returns are a matrix of dates and symbols, cut into blocks of `width` symbols. A date meets a date only as a whole row of
    two blocks, and a pair of blocks gives one matrix product for each sum (n, x, y, xx, yy, xy, missing returns left out), which
    tasks add up over their dates before anything is shuffled. So no pair of rows is joined on dates.
    """
    r = bars.withColumn("ret", change(F.col("close"))).where("ret is not null").select("symbol", "d", "ret")
    symbols = ordered.numbered(r.select("symbol").distinct(), ["symbol"], "i").withColumn("i", F.col("i") - 1)
    # returns about their symbol's mean: sums of squares then lose no digits
    mean = r.groupBy("symbol").agg(F.avg("ret").alias("m"))
    r = r.join(symbols.join(mean, "symbol"), "symbol").withColumn("ret", F.col("ret") - F.col("m"))
    rows = r.groupBy("d", F.floor(F.col("i") / width).cast("int").alias("block")).agg(F.collect_list(F.struct((F.col("i") % width).cast("int").alias("k"), F.col("ret").alias("x"))).alias("row"))
    left, right = rows.select("d", F.col("block").alias("p"), F.col("row").alias("u")), rows.select("d", F.col("block").alias("q"), F.col("row").alias("v"))
    pairs = left.join(right, "d").where("p <= q").select("p", "q", "u", "v")  # blocks squared for each date, a row being a block wide

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}

        def dense(col, n):
            out = np.full((n, width), np.nan)
            flat = col.flatten()
            out[np.repeat(np.arange(n), np.diff(col.offsets.to_numpy())), flat.field("k").to_numpy()] = flat.field("x").to_numpy()
            return out

        for b in batches:
            n = len(b)
            p, q, u, v = b.column(0).to_numpy(), b.column(1).to_numpy(), dense(b.column(2), n), dense(b.column(3), n)
            for key in set(zip(p.tolist(), q.tolist())):
                of = (p == key[0]) & (q == key[1])
                x, y = u[of], v[of]
                hx, hy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                got = np.stack([hx.T @ hy, x.T @ hy, hx.T @ y, (x * x).T @ hy, hx.T @ (y * y), x.T @ y])
                sums[key] = sums[key] + got if key in sums else got
        for (p, q), got in sums.items():
            a, c = np.nonzero(got[0])
            cols = [pa.array(a + p * width), pa.array(c + q * width), *(pa.array(s[a, c]) for s in got)]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    made = pairs.mapInArrow(run, "i long, j long, n double, x double, y double, xx double, yy double, xy double").where("i <= j").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    cov, vx, vy = F.col("xy") - x * y / n, F.col("xx") - x * x / n, F.col("yy") - y * y / n
    corr = F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    names = lambda k, c: symbols.select(F.col("symbol").alias(c), F.col("i").alias(k))
    half = made.join(names("i", "a"), "i").join(names("j", "b"), "j").select("a", "b", F.when(F.col("i") == F.col("j"), F.when(n > 1, F.lit(1.0))).otherwise(corr).alias("corr"))
    # a pair stands in both orders, made from one sum
    return half.select(F.explode(F.array_distinct(F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr")))).alias("p")).select("p.*")


def feature_pairs(features: DataFrame, names: list[str], limit: float = 0.9) -> DataFrame:
    """Pairs of features whose absolute correlation is over limit: one aggregate over the rows, no self-join."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = features.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("p")).select("p.*")
    return long.where(F.abs("corr") > limit)


def label_correlation(features: DataFrame, names: list[str], label: str = "label", limit: float = 0.95) -> DataFrame:
    """feature, corr with the label, leak flag; one aggregate."""
    row = features.agg(*(F.corr(c, label).alias(c) for c in names))
    return row.unpivot([], list(names), "feature", "corr").withColumn("leak", F.abs("corr") > limit)


def top_fraction(correlations: DataFrame, keep: float = 0.6) -> DataFrame:
    """The int(n * keep) features (1 at least) of largest absolute correlation."""
    w = Window.partitionBy().orderBy(F.desc(F.abs("corr")), "feature")  # features are a few dozen rows
    n = F.greatest(F.floor(F.count("*").over(Window.partitionBy()) * keep), F.lit(1))
    return correlations.withColumns({"rank": F.row_number().over(w), "n": n}).where("rank <= n").select("feature", "corr", "rank")
