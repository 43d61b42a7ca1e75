"""Queries over databases, tables and views that are made, changed and dropped, and what SHOW tells of them."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from larkspur import streaming
from larkspur.catalog import query
from larkspur.sources import ddl, table


@contextmanager
def _database(spark):
    name = f"larkspur_{uuid.uuid4().hex[:12]}"
    ddl.create_database(spark, name, streaming.shared_folder(spark))
    try:
        yield name
    finally:
        ddl.drop_database(spark, name)


def _kept(df):
    """The rows of a frame whose tables are about to go; a catalog's frame is small."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _two_tables(spark, db, sf_dir):
    ddl.create_table(spark, f"{db}.area", "r_regionkey INT, r_name STRING", {"PRIMARY": ["r_regionkey"]})
    ddl.create_table(spark, f"{db}.land", "n_nationkey INT, n_name STRING, n_regionkey INT", {"PRIMARY": ["n_nationkey"], "by_name": ["n_regionkey", "n_name"], "to_area": [["n_regionkey"], "area", ["r_regionkey"]]})
    ddl.insert(spark, f"{db}.area", table(spark, sf_dir, "region"))
    ddl.insert(spark, f"{db}.land", table(spark, sf_dir, "nation"))
    return spark


@query("ddl_create_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ddl_create_table(spark, sf_dir):
    with _database(spark) as db:
        return _kept(_two_tables(spark, db, sf_dir).table(f"{db}.land"))


@query("ddl_drop_table", "SELECT 'area' AS table_name")
def ddl_drop_table(spark, sf_dir):
    with _database(spark) as db:
        _two_tables(spark, db, sf_dir).sql(f"DROP TABLE {db}.land")
        return _kept(spark.sql(f"SHOW TABLES IN {db}").where("NOT isTemporary").selectExpr("tableName AS table_name"))


@query("ddl_rename_table", "SELECT 'area' AS table_name, 0 AS n UNION ALL SELECT 'state', count(*) FROM nation")
def ddl_rename_table(spark, sf_dir):
    with _database(spark) as db:
        _two_tables(spark, db, sf_dir)
        ddl.rename_table(spark, f"{db}.land", f"{db}.state")
        ddl.truncate(spark, f"{db}.area")
        return _kept(ddl.table_status(spark, db).selectExpr("name AS table_name", "coalesce(n_rows, 0) AS n"))


@query("ddl_create_view", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def ddl_create_view(spark, sf_dir):
    with _database(spark) as db:
        _two_tables(spark, db, sf_dir).sql(f"CREATE VIEW {db}.placed AS SELECT n_name, r_name FROM {db}.land JOIN {db}.area ON n_regionkey = r_regionkey")
        return _kept(spark.table(f"{db}.placed"))


@query("ddl_drop_view", "SELECT 'kept' AS table_name, 'SELECT 1 AS one' AS view_definition")
def ddl_drop_view(spark, sf_dir):
    with _database(spark) as db:
        for name in ("kept", "gone"):
            spark.sql(f"CREATE VIEW {db}.{name} AS SELECT 1 AS one")
        spark.sql(f"DROP VIEW {db}.gone")
        return _kept(ddl.views(spark, db))


@query("ddl_use_database", "SELECT 1 AS inside, 0 AS after")
def ddl_use_database(spark, sf_dir):
    before = spark.catalog.currentDatabase()
    with _database(spark) as db:
        try:
            spark.sql(f"USE {db}")
            inside = int(spark.sql("SELECT current_database() AS d").first()["d"] == db)
        finally:
            spark.sql(f"USE {before}")
    return spark.createDataFrame([(inside, sum(d.name == db for d in spark.catalog.listDatabases()))], "inside int, after int")


@query("show_databases", "SELECT 1 AS n")
def show_databases(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.schemata(spark).where(f"schema_name = '{db}'").selectExpr("CAST(count(*) AS INT) AS n"))


@query("show_index", "SELECT * FROM (VALUES ('PRIMARY', 1, 'n_nationkey'), ('by_name', 1, 'n_regionkey'), ('by_name', 2, 'n_name')) t(key_name, seq_in_index, column_name)")
def show_index(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.show_index(_two_tables(spark, db, sf_dir), db, "land").select("key_name", "seq_in_index", "column_name"))


@query("show_table_status", "SELECT 'area' AS name, 'parquet' AS engine, count(*) AS n_rows FROM region UNION ALL SELECT 'land', 'parquet', count(*) FROM nation")
def show_table_status(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.table_status(_two_tables(spark, db, sf_dir), db))


@query("show_variables", "SELECT 'larkspur.greeting' AS variable_name, 'hello' AS value")
def show_variables(spark, sf_dir):
    spark.sql("SET larkspur.greeting=hello")
    return ddl.show_variables(spark, "larkspur.greet%")


@query("schema_table_constraints", "SELECT * FROM (VALUES ('area', 'PRIMARY', 'PRIMARY KEY'), ('land', 'PRIMARY', 'PRIMARY KEY'), ('land', 'by_name', 'UNIQUE'), ('land', 'to_area', 'FOREIGN KEY')) t(table_name, constraint_name, constraint_type)")
def schema_table_constraints(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.table_constraints(_two_tables(spark, db, sf_dir), db))


@query("schema_key_column_usage", "SELECT * FROM (VALUES ('area', 'PRIMARY', 'r_regionkey', NULL), ('land', 'PRIMARY', 'n_nationkey', NULL), ('land', 'by_name', 'n_regionkey', NULL), ('land', 'by_name', 'n_name', NULL), ('land', 'to_area', 'n_regionkey', 'r_regionkey')) t(table_name, constraint_name, column_name, referenced_column_name)")
def schema_key_column_usage(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.key_column_usage(_two_tables(spark, db, sf_dir), db).select("table_name", "constraint_name", "column_name", "referenced_column_name"))
