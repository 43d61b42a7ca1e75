"""Databases, tables and views in Spark's catalog, and the frames that SHOW and the information schema give of them.

Tables are Parquet under a folder of the database; keys are declared, not enforced, and kept as table properties.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = "larkspur.keys"


def create_database(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{folder}'")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def create_table(spark: SparkSession, name: str, columns: str, keys: dict[str, list] | None = None) -> None:
    """keys: for PRIMARY, or the name of a unique key or an index, its columns; for a foreign key (columns, table, columns)."""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet TBLPROPERTIES ('{_KEYS}' = '{json.dumps(keys or {})}')")


def _set_keys(spark: SparkSession, name: str, keys: dict[str, list]) -> None:
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_KEYS}' = '{json.dumps(keys)}')")


def _keys_of(spark: SparkSession, name: str) -> dict[str, list]:
    held = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return json.loads(held.get(_KEYS, "{}"))


def create_index(spark: SparkSession, name: str, index: str, columns: list[str]) -> None:
    """Declares an index. Parquet has row groups with their least and greatest values instead of one; ``files.optimize`` by
    these columns makes them narrow."""
    keys = _keys_of(spark, name)
    if index in keys:
        raise ValueError(f"{index} is there already")
    missing = set(columns) - set(spark.table(name).columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    _set_keys(spark, name, {**keys, index: columns})


def drop_index(spark: SparkSession, name: str, index: str) -> None:
    keys = _keys_of(spark, name)
    if keys.pop(index, None) is None:
        raise ValueError(f"no index {index}")
    _set_keys(spark, name, keys)


def insert(spark: SparkSession, name: str, rows: DataFrame) -> None:
    rows.select(*spark.table(name).columns).write.insertInto(name)


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def _names(spark: SparkSession, database: str) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database) if t.tableType != "VIEW" and not t.isTemporary)


def _keys(spark: SparkSession, database: str) -> list[tuple[str, str, list]]:
    return [(t, name, columns) for t in _names(spark, database) for name, columns in _keys_of(spark, f"`{database}`.`{t}`").items()]


def schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")


def views(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, view_definition) of stored views."""
    rows = []
    for t in spark.catalog.listTables(database):
        if t.tableType == "VIEW" and not t.isTemporary:
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{t.name}`").collect()}
            rows.append((t.name, told.get("View Text")))
    return spark.createDataFrame(rows, "table_name string, view_definition string")


def table_constraints(spark: SparkSession, database: str) -> DataFrame:
    kind = lambda name, c: "PRIMARY KEY" if name == "PRIMARY" else "FOREIGN KEY" if c and isinstance(c[0], list) else "UNIQUE"
    return spark.createDataFrame([(t, name, kind(name, c)) for t, name, c in _keys(spark, database)], "table_name string, constraint_name string, constraint_type string")


def key_column_usage(spark: SparkSession, database: str) -> DataFrame:
    rows = []
    for t, name, c in _keys(spark, database):
        own, other, there = c if c and isinstance(c[0], list) else (c, None, [])
        rows += [(t, name, x, i, other, there[i - 1] if there else None) for i, x in enumerate(own, 1)]
    return spark.createDataFrame(rows, "table_name string, constraint_name string, column_name string, ordinal_position int, referenced_table_name string, referenced_column_name string")


def show_index(spark: SparkSession, database: str, name: str) -> DataFrame:
    """SHOW INDEX: (key_name, non_unique, seq_in_index, column_name)."""
    rows = [(k, 0, i, x) for t, k, c in _keys(spark, database) if t == name and not (c and isinstance(c[0], list)) for i, x in enumerate(c, 1)]
    return spark.createDataFrame(rows, "key_name string, non_unique int, seq_in_index int, column_name string")


def table_status(spark: SparkSession, database: str) -> DataFrame:
    """SHOW TABLE STATUS: (name, engine, n_rows), the rows as ANALYZE TABLE has counted them."""
    rows = []
    for t in _names(spark, database):
        spark.sql(f"ANALYZE TABLE `{database}`.`{t}` COMPUTE STATISTICS")
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{t}`").collect()}
        n = [x for x in told.get("Statistics", "").split(", ") if x.endswith("rows")]
        rows.append((t, told.get("Provider"), int(n[0].split()[0]) if n else None))
    return spark.createDataFrame(rows, "name string, engine string, n_rows long")


def show_variables(spark: SparkSession, pattern: str = "%") -> DataFrame:
    """SHOW VARIABLES LIKE: the session's settings as (variable_name, value)."""
    return spark.sql("SET").selectExpr("key AS variable_name", "value").where(f"variable_name LIKE '{pattern}'")


def set_variable(spark: SparkSession, name: str, value: object) -> None:
    """SET @@name = value: a setting of the session; Spark's own settings by their own names."""
    spark.conf.set(name if name.startswith("spark.") else f"larkspur.{name}", str(value))


def variable(spark: SparkSession, name: str) -> Column:
    """@@name as a column expression, null if it was never set."""
    return F.lit(spark.conf.get(name if name.startswith("spark.") else f"larkspur.{name}", None))


def show_create_database(spark: SparkSession, database: str) -> DataFrame:
    names = [(d.name, f"CREATE DATABASE `{d.name}`") for d in spark.catalog.listDatabases(database)]
    return spark.createDataFrame(names, "database string, create_database string")


def show_create_view(spark: SparkSession, database: str, name: str) -> DataFrame:
    return views(spark, database).where(F.col("table_name") == name).select(F.col("table_name").alias("view"), F.concat(F.lit("CREATE VIEW `"), "table_name", F.lit("` AS "), "view_definition").alias("create_view"))


def analyze(spark: SparkSession, name: str) -> DataFrame:
    """ANALYZE TABLE: (column_name, distinct_count, null_count), which the optimiser has from then on; the distinct counts are
    those of a sketch."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    rows = []
    for c in spark.table(name).columns:
        told = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {name} `{c}`").collect()}
        rows.append((c, int(told["distinct_count"]), int(told["num_nulls"])))
    return spark.createDataFrame(rows, "column_name string, distinct_count long, null_count long")


#: The collations and character sets that SHOW gives.
COLLATIONS = (("utf8mb4_general_ci", "utf8mb4", 45, "Yes"), ("utf8mb4_unicode_ci", "utf8mb4", 224, ""), ("utf8mb4_bin", "utf8mb4", 46, ""), ("utf8_general_ci", "utf8", 33, "Yes"), ("latin1_swedish_ci", "latin1", 8, "Yes"))
CHARSETS = (("utf8mb4", "UTF-8 Unicode", "utf8mb4_general_ci", 4), ("utf8", "UTF-8 Unicode", "utf8_general_ci", 3), ("latin1", "cp1252 West European", "latin1_swedish_ci", 1), ("ascii", "US ASCII", "ascii_general_ci", 1))


def show_collation(spark: SparkSession, pattern: str = "%") -> DataFrame:
    return spark.createDataFrame(COLLATIONS, "collation string, charset string, id long, is_default string").where(F.col("collation").like(pattern))


def show_charset(spark: SparkSession, pattern: str = "%") -> DataFrame:
    return spark.createDataFrame(CHARSETS, "charset string, description string, default_collation string, maxlen int").where(F.col("charset").like(pattern))
