"""Data quality: per-symbol reports, the ten checks, corporate actions, scores, provider health, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendar import is_trading_day
from .windows import by, change

MIN_ROWS, OUTLIER, LARGE_MOVE = 500, 0.40, 0.15
REQUIRED = ("open", "high", "low", "close", "volume")


def check_schema(df: DataFrame) -> None:
    missing = set(REQUIRED) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")


def report(bars: DataFrame, arrival: str = "d") -> DataFrame:
    """One row per symbol: counts of rows, repeated dates, steps back in order of arrival, rows with a NULL, range violations, outlier days; included or not."""
    check_schema(bars)
    o, h, l, c, v = (F.col(x) for x in REQUIRED)
    df = bars.withColumns({"ret": change(c), "back": F.col("d") < F.lag("d").over(Window.partitionBy("symbol").orderBy(arrival))})
    missing = F.greatest(*(x.isNull() for x in (o, h, l, c, v)))
    out = df.groupBy("symbol").agg(
        F.count("*").alias("row_count"), (F.count("*") - F.count_distinct("d")).alias("duplicate_dates"), F.count_if("back").alias("out_of_order"), F.count_if(missing).alias("missing_value_rows"),
        F.count_if(h < l).alias("high_below_low"), F.count_if((h < o) | (h < c)).alias("high_below_body"), F.count_if((l > o) | (l > c)).alias("low_above_body"), F.count_if(c <= 0).alias("non_positive_close"), F.count_if(v < 0).alias("negative_volume"),
        F.count_if(F.abs("ret") > OUTLIER).alias("outlier_days"), F.min("d").alias("first_date"), F.max("d").alias("last_date"),
    )
    return out.withColumn("included", F.col("row_count") >= MIN_ROWS)


VIOLATIONS = ("high_below_low", "high_below_body", "low_above_body", "non_positive_close", "negative_volume")


def large_moves(bars: DataFrame) -> DataFrame:
    """Moves of more than 15% between closes on a day without dividend or split; a previous close of 0 is passed over."""
    df = bars.withColumn("move", change(F.col("close")))
    action = F.lit(False)
    for c in ("dividend", "split_ratio"):
        if c in bars.columns:
            action = action | F.col(c).isNotNull()
    return df.where((F.abs("move") > LARGE_MOVE) & ~action).select("symbol", "d", "move")


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """Per symbol: trading days between its first and last bar without a bar, and bars on days without trading.

    Counted from the spans alone: trading days in the span less distinct bars on trading days. No calendar is joined.
    """
    per = bars.select("symbol", "d").distinct().groupBy("symbol").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count_if(is_trading_day(F.col("d"))).alias("good"), F.count_if(~is_trading_day(F.col("d"))).alias("non_trading_rows"))
    days = F.size(F.filter(F.sequence("a", "z"), is_trading_day))
    return per.select("symbol", (days - F.col("good")).alias("missing_dates"), "non_trading_rows")


def validate(bars: DataFrame, registry: DataFrame, arrival: str = "d") -> DataFrame:
    """symbol, check_name, passed: ten rows for each symbol. Adjusted closes aren't held, so that check passes and says nothing."""
    r = report(bars, arrival).join(calendar_gaps(bars), "symbol").join(large_moves(bars).groupBy("symbol").agg(F.count("*").alias("moves")), "symbol", "left")
    r = r.join(registry.select("symbol").distinct().withColumn("known", F.lit(True)), "symbol", "left")
    checks = {
        "ohlc_integrity": sum((F.col(c) for c in VIOLATIONS), F.lit(0)) == 0, "duplicate_row": F.col("duplicate_dates") == 0, "missing_date_calendar": F.col("missing_dates") == 0, "calendar_consistency": F.col("non_trading_rows") == 0,
        "symbol_identity": F.coalesce("known", F.lit(False)), "volume_anomaly": F.col("negative_volume") == 0, "price_anomaly": F.col("outlier_days") == 0, "adjusted_close_consistency": F.lit(True),
        "corporate_action_consistency": F.coalesce("moves", F.lit(0)) == 0, "timestamp_ordering": F.col("out_of_order") == 0,
    }
    return r.select("symbol", *(v.alias(k) for k, v in checks.items())).unpivot("symbol", list(checks), "check_name", "passed")


def score(bars: DataFrame, today: Column) -> DataFrame:
    """Five parts from 0 to 100 and their mean, two decimals."""
    ok = F.col("included")
    r = report(bars).join(large_moves(bars).groupBy("symbol").agg(F.count("*").alias("moves")), "symbol", "left")
    fresh = F.greatest(F.lit(0.0), 100.0 - F.greatest(F.lit(0), F.datediff(today, "last_date") - 3) * 5.0)
    mean = lambda x: 100.0 * F.coalesce(F.avg(F.when(ok, x)), F.lit(0.0))
    clean = ((sum((F.col(c) for c in VIOLATIONS), F.lit(0)) == 0) & (F.col("duplicate_dates") == 0)).cast("double")
    out = r.agg(
        mean(1 - F.col("missing_value_rows") / F.col("row_count")).alias("completeness"), mean(clean).alias("integrity"), (100.0 * F.count_if(ok) / F.count("*")).alias("coverage"), F.avg(fresh).alias("freshness"),
        F.coalesce(F.avg(F.when(F.coalesce("moves", F.lit(0)) == 0, 100.0).otherwise(0.0)), F.lit(100.0)).alias("corporate_action_validation"),
    )
    parts = out.columns
    return out.withColumn("composite", sum((F.col(c) for c in parts), F.lit(0.0)) / 5).select(*(F.bround(c, 2).alias(c) for c in [*parts, "composite"]))


def provider_health(calls: DataFrame) -> DataFrame:
    """Per provider: calls, success rate, median and 95th latency (nearest rank, index rounded half to even), failures by type, last success."""
    w = Window.partitionBy("provider")
    # a row for each millisecond, not for each call
    hist = calls.where("latency_ms is not null").groupBy("provider", "latency_ms").agg(F.count("*").alias("k"))
    hist = hist.withColumns({"upto": F.sum("k").over(w.orderBy("latency_ms")), "n": F.sum("k").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * p, 0), F.col("latency_ms")))
    ranks = hist.groupBy("provider").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    main = calls.groupBy("provider").agg(F.count("*").alias("calls"), F.bround(F.count_if("success") / F.count("*"), 2).alias("success_rate"), F.max(F.when(F.col("success"), F.col("call_timestamp"))).alias("last_success"))
    main = main.join(ranks, "provider", "left")
    kinds = calls.where("failure_type is not null").groupBy("provider", "failure_type").agg(F.count("*").alias("n")).groupBy("provider").agg(F.array_join(F.array_sort(F.collect_list(F.concat("failure_type", F.lit("="), F.col("n").cast("string")))), ",").alias("failures"))
    return main.join(kinds, "provider", "left")


def metadata(bars: DataFrame) -> DataFrame:
    """symbol, first and last date, rows, SHA-256 over `date,close` joined by | in order of date."""
    line = F.concat(F.col("d").cast("string"), F.lit(","), F.col("close").cast("string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", line.alias("x")))), lambda r: r["x"]), "|")
    return bars.groupBy("symbol").agg(F.min("d").alias("first_date"), F.max("d").alias("latest_date"), F.count("*").alias("row_count"), F.sha2(joined, 256).alias("checksum"))


def dataset_summary(bars: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Rows, symbols and dates over symbols with enough rows."""
    per = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("z")).where(f"n >= {least}")
    return per.agg(F.sum("n").alias("row_count"), F.count("*").alias("symbol_count"), F.min("a").alias("start_date"), F.max("z").alias("end_date"))
