"""Information-schema frames from Spark's catalog, and ALTER TABLE as frame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string")


def columns(spark: SparkSession, name: str) -> DataFrame:
    rows = [(name, c.name, i, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(name), 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")


def create_table(df: DataFrame, name: str) -> str:
    """DDL text of a frame."""
    return f"CREATE TABLE {name} (" + ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" + ("" if f.nullable else " NOT NULL") for f in df.schema) + ")"


def add_column(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    return df.withColumn(name, F.lit(default).cast(kind))


def modify_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.col(name).try_cast(kind))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)
