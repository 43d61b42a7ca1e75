"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """Register the named tables (all without names) as temporary views; the session, for chaining."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
