"""Quantified comparison with a subquery, which Spark SQL has no grammar for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def compare_all(df: DataFrame, column: str, op: str, sub: DataFrame, value: str) -> DataFrame:
    """Rows whose column compares so with every value of the subquery: all of them if it is empty, none if it has a
    null. The subquery is reduced to one row before it is joined."""
    one = sub.agg(F.count("*").alias("q_n"), F.count(value).alias("q_known"), F.min(value).alias("q_min"), F.max(value).alias("q_max"))
    c = F.col(column)
    if op == "=":
        holds = (c == F.col("q_min")) & (c == F.col("q_max"))
    elif op == "<>":
        return df.join(one, F.lit(True)).where((F.col("q_n") == 0) | ((F.col("q_n") == F.col("q_known")) & c.isNotNull())).join(sub.select(F.col(value).alias("q_v")), c == F.col("q_v"), "left_anti").select(*df.columns)
    else:
        holds = _OPS[op](c, F.col("q_max") if op in (">", ">=") else F.col("q_min"))
    keep = (F.col("q_n") == 0) | ((F.col("q_n") == F.col("q_known")) & holds)
    return df.join(one, F.lit(True)).where(keep).select(*df.columns)


def compare_any(df: DataFrame, column: str, op: str, sub: DataFrame, value: str) -> DataFrame:
    """Rows whose column compares so with some value of the subquery."""
    c = F.col(column)
    if op == "=":
        return df.join(sub.select(F.col(value).alias("q_v")).distinct(), c == F.col("q_v"), "left_semi")
    one = sub.agg(F.min(value).alias("q_min"), F.max(value).alias("q_max"))
    if op == "<>":
        holds = (c != F.col("q_min")) | (c != F.col("q_max"))
    else:
        holds = _OPS[op](c, F.col("q_min") if op in (">", ">=") else F.col("q_max"))
    return df.join(one, F.lit(True)).where(holds).select(*df.columns)
