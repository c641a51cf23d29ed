"""Registered queries and the DuckDB SQL that checks them.

Doubles are rounded to six places on both sides: the order in which an engine adds them up is its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*(F.round(F.col(c), DIGITS).alias(c) if c in names else F.col(c) for c in df.columns))


def query(sql: str | None = None, doubles: str = ""):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with its SQL; doubles names the columns to round.
    Others are exact: single operations on the same doubles."""

    def add(f):
        cols = doubles.split()
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), cols) if cols else f(spark, sf_dir)
        if sql is not None:
            head = "SELECT *" if not cols else "SELECT * REPLACE (" + ", ".join(f"round({c}::double, {DIGITS}) + 0.0::double AS {c}" for c in cols) + ")"
            SQL[f.__name__] = f"{head} FROM ({sql})"
        return f

    return add
