"""Trading calendar: weekdays that aren't holidays; session phases in exchange time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The exchange's published holidays. Other years have weekdays only.
HOLIDAYS = {
    "2026-01-26": "Republic Day", "2026-03-03": "Holi", "2026-03-26": "Shri Ram Navami", "2026-03-31": "Shri Mahavir Jayanti", "2026-04-03": "Good Friday", "2026-04-14": "Dr. Baba Saheb Ambedkar Jayanti",
    "2026-05-01": "Maharashtra Day", "2026-05-28": "Bakri Id", "2026-06-26": "Muharram", "2026-09-14": "Ganesh Chaturthi", "2026-10-02": "Mahatma Gandhi Jayanti", "2026-10-20": "Dussehra",
    "2026-11-10": "Diwali-Balipratipada", "2026-11-24": "Prakash Gurpurb Sri Guru Nanak Dev", "2026-12-25": "Christmas",
}
ZONE = "Asia/Kolkata"


def is_trading_day(d: Column) -> Column:
    return (F.weekday(d) < 5) & ~F.date_format(d, "yyyy-MM-dd").isin(*HOLIDAYS)


def _closed_runs(holidays) -> int:
    """The longest run of days without trading: weekends and holidays that lie side by side."""
    days = sorted(dt.date.fromisoformat(h) for h in holidays)
    shut = {d + dt.timedelta(k) for d in days for k in range(-9, 10) if (d + dt.timedelta(k)).weekday() > 4} | set(days)
    longest = run = 0
    before = None
    for d in sorted(shut):
        run = run + 1 if before is not None and (d - before).days == 1 else 1
        longest, before = max(longest, run), d
    return max(longest, 2)


def _step(d: Column, sign: int) -> Column:
    # one day more than the longest run of closed days, whatever the holidays are, so there always is an answer
    days = F.transform(F.sequence(F.lit(1), F.lit(_closed_runs(HOLIDAYS) + 1)), lambda n: F.date_add(d, (n * sign).cast("int")))
    return F.get(F.filter(days, is_trading_day), F.lit(0))


def next_trading_day(d: Column) -> Column:
    return _step(d, 1)


def previous_trading_day(d: Column) -> Column:
    return _step(d, -1)


def dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date '{first}', date '{last}')) AS d")


def phase(ts: Column) -> Column:
    """Session phase of a UTC time: closed, pre_open, open, post_close."""
    local = F.from_utc_timestamp(ts, ZONE)
    at = F.date_format(local, "HH:mm:ss")
    return (
        F.when(~is_trading_day(F.to_date(local)), "closed").when(at < "09:00:00", "closed").when(at < "09:15:00", "pre_open").when(at <= "15:30:00", "open").when(at <= "16:00:00", "post_close").otherwise("closed")
    )


def target_session(ts: Column) -> Column:
    return next_trading_day(F.to_date(F.from_utc_timestamp(ts, ZONE)))


def days_behind(latest: Column, expected: Column, cap: int = 60) -> Column:
    """Trading days from latest to expected, counted back from expected; 0 if it isn't behind, cap at most."""
    n = F.size(F.filter(F.sequence(latest, F.date_sub(expected, 1)), is_trading_day))
    # a latest date without trading is passed at the trading day before it
    n = n + F.when(is_trading_day(latest), 0).otherwise(1)
    return F.when(latest >= expected, 0).when(latest.isNotNull(), F.least(n, F.lit(cap)))


def freshness(behind: Column) -> Column:
    return F.when(behind.isNull(), "Unknown").when(behind == 0, "Fresh").when(behind == 1, "Delayed").otherwise("Stale")


def with_previous(trading: DataFrame) -> DataFrame:
    """d and prev_d of a table of trading days."""
    return trading.select("d", F.lag("d").over(Window.partitionBy().orderBy("d")).alias("prev_d"))  # one row per day
