"""Table modification as DataFrame to DataFrame transforms: the result is what the table holds afterwards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A row that a constraint forbids."""


def _last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row a key, the last by order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))).where("_n = 1").drop("_n")


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """INSERT: missing columns get their default or null."""
    defaults = defaults or {}
    full = rows.select(*[F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(full)


def _whole(rows: DataFrame) -> Column:
    """An order of rows by all their values, for where none is given: any, but always the same."""
    return F.struct(*[F.col(c) for c in rows.columns])


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """INSERT IGNORE: rows whose key is there already are left out; of several of a key the first by order is taken, without
    an order the least row."""
    held = F.struct(*[F.col(c) for c in rows.columns]).alias("_row")
    first = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min_by(held, order if order is not None else _whole(rows)).alias("_row")).select("_row.*")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def replace(table: DataFrame, rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """REPLACE: a row takes the place of the one with its key; of several the last by order, without one the greatest row."""
    new = _last(rows, keys, order if order is not None else _whole(rows))
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: Mapping[str, Column], order: Column | None = None) -> DataFrame:
    """ON DUPLICATE KEY UPDATE. In ``update`` columns of the table go by their names, those of the new row as
    ``new_<name>``. Of several new rows of a key only the last by order updates, without an order the greatest row."""
    rows = _last(rows, keys, order if order is not None else _whole(rows))
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in table.columns])
    on = [F.col(k) == F.col(f"new_{k}") for k in keys]
    both = table.join(new, on, "full_outer")
    there, comes = F.col(keys[0]).isNotNull(), F.col(f"new_{keys[0]}").isNotNull()
    return both.select(*[F.when(there & comes, update.get(c, F.col(c))).when(there, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in table.columns])


def update(table: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return table.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def cascade_delete(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of the child that still have a parent, or none by a null key."""
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_semi").unionByName(child.where(F.col(key).isNull()))


def set_null(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The child with null where its parent is gone."""
    there = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.join(there, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).select(*child.columns)


def violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def check_violations(table: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; null passes."""
    return table.where(~F.coalesce(check, F.lit(True)))


def require(check: DataFrame, message: str) -> None:
    if check.limit(1).count():
        raise ConstraintError(message)
