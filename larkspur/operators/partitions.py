"""Partition routing: the number or name of the partition a row belongs to, as a column to write by or to prune with."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_range(value: Column, less_than: Sequence[int | None]) -> Column:
    """VALUES LESS THAN, ascending; None is MAXVALUE. Null goes to the first; what no bound holds is null."""
    out = F.when(value.isNull(), 0)
    for i, bound in enumerate(less_than):
        out = out.otherwise(i) if bound is None else out.when(value < bound, i)
    return out


def by_list(value: Column, lists: Mapping[str, Sequence[object]]) -> Column:
    """VALUES IN; None in a list takes nulls."""
    out = F.lit(None).cast("string")
    for name, held in lists.items():
        hit = F.coalesce(value.isin([v for v in held if v is not None]), F.lit(False))
        out = F.when(hit | value.isNull() if None in held else hit, name).otherwise(out)
    return out


def by_hash(value: Column, n: int) -> Column:
    """HASH of a whole number: the remainder of its amount; null counts as 0."""
    return F.coalesce(F.abs(value) % n, F.lit(0)).cast("int")


def by_linear_hash(value: Column, n: int) -> Column:
    """LINEAR HASH: the lowest bits that n needs, one bit less where that is no partition; null counts as 0."""
    mask = (1 << (n - 1).bit_length()) - 1
    whole = F.coalesce(F.abs(value).cast("long"), F.lit(0))
    part = whole.bitwiseAND(F.lit(mask))
    return F.when(part >= n, whole.bitwiseAND(F.lit(mask >> 1))).otherwise(part).cast("int")


def by_range_columns(values: Sequence[Column], less_than: Sequence[tuple | None]) -> Column:
    """RANGE COLUMNS: bounds are tuples, compared one column after another; None is MAXVALUE."""
    out = None
    for i, bound in enumerate(less_than):
        if bound is None:
            return F.lit(i) if out is None else out.otherwise(i)
        below = F.lit(False)
        for value, b in reversed(list(zip(values, bound, strict=True))):
            below = (value < b) | ((value == b) & below)
        out = F.when(below, i) if out is None else out.when(below, i)
    return out


def by_key(*values: Column, n: int) -> Column:
    """KEY of any columns, by a hash of them."""
    return F.pmod(F.xxhash64(*values), F.lit(n)).cast("int")
