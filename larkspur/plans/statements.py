"""Queries over partition routing, write-path hooks, introspection, export and further stream windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import streaming
from larkspur.catalog import query
from larkspur.operators import dml, partitions, ranking
from larkspur.plans.system import _stream
from larkspur.sources import files, schema, table, views

F_ = F.col


@query("partition_range", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS part_no FROM part")
def partition_range(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", partitions.by_range(F_("p_size"), [10, 30, None]).alias("part_no"))


@query("partition_list", "SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 1) THEN 'west' WHEN n_regionkey = 3 OR n_regionkey IS NULL THEN 'rest' END AS part_name FROM nation")
def partition_list(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", partitions.by_list(F_("n_regionkey"), {"west": [0, 1], "rest": [3, None]}).alias("part_name"))


@query("partition_hash", "SELECT o_orderkey, CAST(o_orderkey % 7 AS INT) AS part_no FROM orders")
def partition_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", partitions.by_hash(F_("o_orderkey"), 7).alias("part_no"))


@query("partition_pruning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partition_pruning(spark, sf_dir):
    path = streaming.shared_folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition("o_orderstatus", F_("o_orderkey") % 8).write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").parquet(path).where("o_orderstatus = 'F'")


@query("auto_increment", "SELECT 1000 + row_number() OVER (ORDER BY n_name) AS id, n_name FROM nation")
def auto_increment(spark, sf_dir):
    # The rows of one statement, in one order, are numbered on from the last id.
    return ranking.numbered(table(spark, sf_dir, "nation").select("n_name"), "n_name", start=1001).select(F_("number").alias("id"), "n_name")


@query("generated_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def generated_column(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr("l_extendedprice * (1 - l_discount)"), 4).alias("net"))


@query("trigger_audit", "SELECT c_custkey, c_acctbal AS old_value, 0.0 AS new_value FROM customer WHERE c_acctbal < 0")
def trigger_audit(spark, sf_dir):
    """AFTER UPDATE with OLD and NEW, for all changed rows at once."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F_("c_acctbal").alias("old_value"))
    new = dml.update(old.withColumn("new_value", F_("old_value")), F_("old_value") < 0, {"new_value": F.lit(0.0)})
    return new.where(~F_("old_value").eqNullSafe(F_("new_value")))


@query("insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 10, n_name FROM nation")
def insert_select(spark, sf_dir):
    return dml.insert(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").select((F_("n_nationkey") + 10).alias("r_regionkey"), F_("n_name").alias("r_name")))


@query("dml_cascade_update", "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_cascade_update(spark, sf_dir):
    keys = table(spark, sf_dir, "region").where("r_regionkey < 2").select("r_regionkey", (F_("r_regionkey") + 100).alias("changed"))
    joined = table(spark, sf_dir, "nation").join(keys, F_("n_regionkey") == F_("r_regionkey"), "left")
    return joined.select("n_nationkey", F.coalesce("changed", "n_regionkey").alias("n_regionkey"))


@query("show_tables", "SELECT * FROM (VALUES ('nation'), ('region')) t(table_name)")
def show_tables(spark, sf_dir):
    views(spark, sf_dir, "nation", "region")
    return schema.tables(spark).where(F_("table_name").isin("nation", "region")).select("table_name")


@query("show_create_table", "SELECT 'CREATE TABLE region (`r_regionkey` INT, `r_name` STRING)' AS ddl")
def show_create_table(spark, sf_dir):
    return spark.createDataFrame([(schema.create_table(table(spark, sf_dir, "region"), "region"),)], "ddl string")


@query("describe_table", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(col_name, data_type)")
def describe_table(spark, sf_dir):
    views(spark, sf_dir, "region")
    return spark.sql("DESCRIBE TABLE region").select("col_name", "data_type")


@query("explain_statement")
def explain_statement(spark, sf_dir):
    views(spark, sf_dir, "region", "nation")
    return spark.sql("EXPLAIN FORMATTED SELECT r_name, count(*) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")


_NULLS = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query("check_table", f"SELECT count(*) AS n, count(*) - count(DISTINCT o_orderkey) AS n_repeated, {_NULLS} FROM orders")
def check_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("o_orderkey")).alias("n_repeated"), *[F.count_if(F_(c).isNull()).alias(f"null_{c}") for c in orders.columns])


@query("backup_restore", "SELECT * FROM supplier")
def backup_restore(spark, sf_dir):
    path, supplier = streaming.shared_folder(spark), table(spark, sf_dir, "supplier")
    files.export(supplier, path)
    return files.load_data(spark, path, ", ".join(f"{c} {t}" for c, t in supplier.dtypes))


@query("optimize_table", "SELECT * FROM customer")
def optimize_table(spark, sf_dir):
    path, customer = streaming.shared_folder(spark), table(spark, sf_dir, "customer")
    files.optimize(customer, path)
    return spark.read.schema(customer.schema).parquet(path)


_SESSION = """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, no"""


@query("stream_session", _SESSION)
def stream_session(spark, sf_dir):
    # The closing event is of a user of its own.
    events = _stream(spark, sf_dir).withColumn("user_id", F.when(F_("event_type") == "end", -1).otherwise(F_("user_id")))
    out = streaming.run_once(streaming.sessions(events, late="100000 hours"))
    return out.where("user_id >= 0").withColumn("session_start", F_("session_start").cast("timestamp_ntz"))
