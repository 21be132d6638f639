"""Typing helpers of the queries: fixed decimals, dates, time stamps for filters that are pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def money(c: str | Column) -> Column:
    """The one fixed decimal type of amounts, -9,999,999,999.99 to 9,999,999,999.99; out of range is an error."""
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def stamp(day: str) -> Column:
    """A constant that compares with a stored time stamp without a cast of the column, so that Parquet filters it."""
    return F.lit(day).cast("timestamp_ntz")


def days_after(c: str | Column, n: int) -> Column:
    return c + F.expr(f"interval {n} days") if isinstance(c, Column) else F.col(c) + F.expr(f"interval {n} days")


def int_divide(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero."""
    return F.call_function("div", a, b)


def ratio(a: Column, b: Column, kind: str = "decimal(18,6)") -> Column:
    """a / b by way of doubles, null where b is 0, rounded to a decimal so that engines agree on the last digits."""
    return F.try_divide(a.cast("double"), b.cast("double")).cast(kind)
