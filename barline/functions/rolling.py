"""Trailing windows by symbol, with an explicit count of values that a result needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def by():
    """Each symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("date")


def rows(k: int):
    """The current bar and the ``k - 1`` before it."""
    return by().rowsBetween(-(k - 1), 0)


def roll(f: Callable, x: str | Column, k: int, least: int | None = None) -> Column:
    """``f`` over the last ``k`` bars; null unless ``least`` (default k) of them have a value."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(rows(k)) >= (k if least is None else least), f(x).over(rows(k)))


def roll2(f: Callable, y: str, x: str, k: int, least: int | None = None) -> Column:
    both = F.col(y) + F.col(x)
    return F.when(F.count(both).over(rows(k)) >= (k if least is None else least), f(F.col(y), F.col(x)).over(rows(k)))


def lag(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(by())


def ratio(a, b) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def observed(x: str) -> Column:
    """How many values ``x`` has had up to each bar: the order of :func:`tail`'s frames."""
    return F.count(x).over(by().rowsBetween(Window.unboundedPreceding, 0))


def known(x: str, before: bool = False) -> Column:
    """The last value of ``x`` up to the bar, or before it."""
    return F.last(x, ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1 if before else 0))


def tail(f: Callable, x: str, count: str, k: int, least: int | None = None) -> Column:
    """``f`` over the last ``k`` values that ``x`` has, however many bars they span; null unless ``least`` (default k) are there.

    ``count`` names the column of :func:`observed`: a frame over its range holds just these values, and bars without one among them.
    """
    last = Window.partitionBy("symbol").orderBy(count).rangeBetween(-(k - 1), 0)
    return F.when(F.col(count) >= (k if least is None else least), f(x).over(last))
