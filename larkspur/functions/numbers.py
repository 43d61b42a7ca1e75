"""Numeric functions and operators with MySQL semantics: dividing by zero gives null, text reads as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.strings import _c, any_null


def to_number(s: Column) -> Column:
    """Lenient: 0 where the text is no number; null stays null."""
    return F.when(s.isNull(), None).otherwise(F.coalesce(s.try_cast("double"), F.lit(0.0)))


def divide(a: Column, b) -> Column:
    return F.try_divide(a.cast("double"), _c(b).cast("double"))


def int_divide(a: Column, b) -> Column:
    return F.when(_c(b) != 0, F.floor(F.abs(a / _c(b))) * F.signum(a / _c(b))).cast("long")


def mod(a: Column, b) -> Column:
    """The sign of the dividend; null for a zero divisor."""
    return F.try_mod(a, _c(b))


def truncate(x: Column, digits: int) -> Column:
    scale = F.lit(float(10.0**digits))
    return F.when(x >= 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)).cast("double") / scale


def greatest(*cols: Column) -> Column:
    """Null if any is null."""
    return F.when(~any_null(*cols), F.greatest(*map(_c, cols)))


def least(*cols: Column) -> Column:
    return F.when(~any_null(*cols), F.least(*map(_c, cols)))


def interval(n: Column, *bounds) -> Column:
    """How many of the ascending bounds are at most n; -1 for null."""
    count = F.lit(0)
    for b in bounds:
        count = count + F.when(_c(b) <= n, 1).otherwise(0)
    return F.when(n.isNull(), -1).otherwise(count).cast("int")


def log(base, x: Column) -> Column:
    """Null outside the domain."""
    return F.when((x > 0) & (_c(base) > 0) & (_c(base) != 1), F.ln(x) / F.ln(_c(base).cast("double")))


def cot(x: Column) -> Column:
    return F.cot(x)


def truth(x: Column) -> Column:
    """A number as a condition."""
    return x != 0
