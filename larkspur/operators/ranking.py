"""Ranks over few large groups: from counts of distinct values, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_by_value(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with ``rank``, ``dense_rank``, ``cume_dist`` and ``percent_rank`` of value within group. All rows of one value have
    the same, so the window goes over the distinct values, which are counted first; the result is joined back."""
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    order, whole = W.partitionBy("_g").orderBy("_v"), W.partitionBy("_g")
    upto, total = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)), F.sum("_n").over(whole)
    ranks = counts.select(
        "_g", "_v", (upto - F.col("_n") + 1).cast("int").alias("rank"), F.dense_rank().over(order).alias("dense_rank"), (upto / total).alias("cume_dist"),
        F.when(total > 1, (upto - F.col("_n")) / (total - 1)).otherwise(0.0).alias("percent_rank"),
    )
    return rows.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def with_group_total(rows: DataFrame, group: str, total: Column, name: str) -> DataFrame:
    """rows with an aggregate of their group, joined back from one row a group."""
    sums = rows.groupBy(F.col(group).alias("_g")).agg(total.alias(name))
    return rows.join(sums, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def numbered(rows: DataFrame, *order: str, start: int = 1) -> DataFrame:
    """rows with ``number``, their place in an order over all of them: the counts of range partitions give each its offset, so
    no task sorts them all."""
    parts = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_q", (F.sum("_n").over(W.orderBy("_q").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return parts.join(before, F.col("_p") == F.col("_q")).withColumn("number", (own + F.col("_before") + F.lit(start - 1)).cast("long")).drop("_p", "_q", "_before")
