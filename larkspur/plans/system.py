"""Queries over streams, files, dialect and schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import dialect, streaming
from larkspur.catalog import query
from larkspur.sources import files, schema, table, views


def _stream(spark, sf_dir):
    """The events as a stream of several files, in time order, closed by a far later event that moves the watermark."""
    events = table(spark, sf_dir, "events")
    folder = streaming.shared_folder(spark)
    events.repartitionByRange("ts").write.parquet(f"{folder}/a")
    last = events.limit(1).select(*[(F.lit("2200-01-01 00:00:00").cast("timestamp_ntz") if c == "ts" else F.lit("end") if c == "event_type" else F.col(c)).alias(c) for c in events.columns])
    last.coalesce(1).write.mode("append").parquet(f"{folder}/a")
    return streaming.source(spark, f"{folder}/a", events, 2)


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = streaming.run_once(streaming.tumbling_counts(_stream(spark, sf_dir), late="100000 hours"))
    return out.where("event_type != 'end'").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_append_log", "SELECT event_id, event_type FROM events")
def stream_append(spark, sf_dir):
    return streaming.run_once(_stream(spark, sf_dir).where("event_type != 'end'").select("event_id", "event_type"))


@query("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    events = _stream(spark, sf_dir).where("event_type != 'end'")
    return streaming.run_once(streaming.deduplicated(events, ["event_id"], "1000000 hours").select("event_id"))


@query("load_data", "SELECT CAST(n_nationkey AS INT) AS k, nullif(n_name, 'FRANCE') AS name FROM nation")
def load_data(spark, sf_dir):
    path = streaming.shared_folder(spark)
    files.export(table(spark, sf_dir, "nation").select("n_nationkey", F.nullif(F.col("n_name"), F.lit("FRANCE")).alias("n")), path)
    return files.load_data(spark, path, "k int, name string")


@query("dialect_top", "SELECT p_partkey AS k, coalesce(p_name, '[x]') AS n FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def dialect_top(spark, sf_dir):
    views(spark, sf_dir, "part")
    return spark.sql(dialect.translate("SELECT TOP 5 [p_partkey] AS k, ISNULL(p_name, N'[x]') AS n FROM part ORDER BY p_retailprice DESC, p_partkey"))


@query("schema_columns", "SELECT * FROM (VALUES ('r_regionkey', 1), ('r_name', 2)) t(column_name, ordinal_position)")
def schema_columns(spark, sf_dir):
    views(spark, sf_dir, "region")
    return schema.columns(spark, "region").select("column_name", "ordinal_position")


@query("alter_table", "SELECT r_regionkey AS k, TRY_CAST(r_name AS INT) AS r_name, 7 AS extra FROM region")
def alter_table(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    return schema.rename_column(schema.add_column(schema.modify_column(region, "r_name", "int"), "extra", "int", 7), "r_regionkey", "k")
