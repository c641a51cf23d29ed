"""Row frames over one symbol's dates. A rolling value is NULL until its frame holds enough values, as everywhere in this library."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

YEAR = 252


def by(newest: bool = False):
    """Each symbol's rows in order of date, or the newest first. Made when called: a window needs a session."""
    return Window.partitionBy("symbol").orderBy(F.desc("d") if newest else "d")


def so_far():
    return by().rowsBetween(Window.unboundedPreceding, 0)


def last(n: int):
    return by().rowsBetween(1 - n, 0)


def rolling(f, c: Column, n: int, least: int | None = None) -> Column:
    """f(c) over the last n rows, where at least `least` (n by default) values aren't NULL."""
    return F.when(F.count(c).over(last(n)) >= (n if least is None else least), f(c).over(last(n)))


def change(c: Column, n: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, n).over(by())) - 1


def rank_of_last(c: Column, n: int, least: int) -> Column:
    """Share of the last n values that c's own rank (average of ties) makes up."""
    frame = F.collect_list(c).over(last(n))
    less = F.size(F.filter(frame, lambda x: x < c))
    equal = F.size(F.filter(frame, lambda x: x == c))
    return F.when(c.isNotNull() & (F.size(frame) >= least), (less + (equal + 1) / 2) / F.size(frame))
