"""Scalar expressions: built-in functions under the engine's names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def volume(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    return F.col(price) * (1 - F.col(discount))


def year(c: str) -> Column:
    return F.year(c).cast("int")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def after(text: str, unit: str, n: int) -> Column:
    """A date and so many days, months or years; the last day of a shorter month stands for days that it lacks."""
    return F.expr(f"DATE '{text}' + INTERVAL '{n}' {unit}")


def before(text: str, unit: str, n: int) -> Column:
    return F.expr(f"DATE '{text}' - INTERVAL '{n}' {unit}")


def within(c: str, text: str, unit: str, n: int) -> Column:
    """From a day until before the day n units later."""
    return (F.col(c) >= day(text)) & (F.col(c) < after(text, unit, n))
