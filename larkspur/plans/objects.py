"""Queries over indexes, events, cursors, stream groups and what SHOW tells of them, and plans that prune what they read."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from larkspur import kv, streaming
from larkspur.catalog import query
from larkspur.operators.events import Events
from larkspur.operators.handler import Handler
from larkspur.operators.routines import Routines, Triggers
from larkspur.plans.ddl import _database, _kept, _two_tables
from larkspur.plans.keyvalue import _NEWS, _START, _STRINGS, _at, _kv, _news, _now, _pending, _strings
from larkspur.plans.tables import _HASH, _LAT, _LON, _STREAM, _ZSET, _geo, _hash, _stream, _zset
from larkspur.sources import ddl, files, table, views

F_ = F.col


# -- catalog
@query("ddl_create_index", "SELECT * FROM (VALUES ('PRIMARY', 1, 'n_nationkey'), ('by_region', 1, 'n_regionkey'), ('by_region', 2, 'n_nationkey')) t(key_name, seq_in_index, column_name)")
def ddl_create_index(spark, sf_dir):
    with _database(spark) as db:
        _two_tables(spark, db, sf_dir)
        ddl.create_index(spark, f"{db}.land", "by_region", ["n_regionkey", "n_nationkey"])
        ddl.drop_index(spark, f"{db}.land", "by_name")
        return _kept(ddl.show_index(spark, db, "land").select("key_name", "seq_in_index", "column_name"))


@query("ddl_drop_database", "SELECT CAST(0 AS BIGINT) AS n")
def ddl_drop_database(spark, sf_dir):
    with _database(spark) as db:
        _two_tables(spark, db, sf_dir)
    return spark.createDataFrame([(sum(d.name == db for d in spark.catalog.listDatabases()),)], "n long")


@query("show_create_view", "SELECT 'kept' AS view, 'CREATE VIEW `kept` AS SELECT 1 AS one' AS create_view")
def show_create_view(spark, sf_dir):
    with _database(spark) as db:
        spark.sql(f"CREATE VIEW {db}.kept AS SELECT 1 AS one")
        return _kept(ddl.show_create_view(spark, db, "kept"))


@query("show_create_database", "SELECT 'CREATE DATABASE `default`' AS create_database")
def show_create_database(spark, sf_dir):
    return ddl.show_create_database(spark, "default").select("create_database")


@query("show_collation", "SELECT * FROM (VALUES ('utf8mb4_general_ci', 45), ('utf8mb4_unicode_ci', 224), ('utf8mb4_bin', 46)) t(\"collation\", id)")
def show_collation(spark, sf_dir):
    return ddl.show_collation(spark, "utf8mb4%").select("collation", "id")


@query("show_charset", "SELECT * FROM (VALUES ('utf8mb4', 4), ('utf8', 3), ('latin1', 1), ('ascii', 1)) t(charset, maxlen)")
def show_charset(spark, sf_dir):
    return ddl.show_charset(spark).select("charset", "maxlen")


@query("analyze_table", "SELECT * FROM (VALUES ('n_nationkey', 0), ('n_name', 0), ('n_regionkey', 0)) t(column_name, null_count)")
def analyze_table(spark, sf_dir):
    with _database(spark) as db:
        return _kept(ddl.analyze(_two_tables(spark, db, sf_dir), f"{db}.land").select("column_name", "null_count"))


@query("system_variable", "SELECT r_name, '40' AS longest FROM region")
def system_variable(spark, sf_dir):
    ddl.set_variable(spark, "longest", 40)
    return table(spark, sf_dir, "region").select("r_name", ddl.variable(spark, "longest").alias("longest"))


@query("explain_json", "SELECT 1 AS joins, 1 AS aggregates")
def explain_json(spark, sf_dir):
    views(spark, sf_dir, "region", "nation")
    plan = spark.sql("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
    nodes = [n["class"].rsplit(".", 1)[-1] for n in json.loads(plan._jdf.queryExecution().optimizedPlan().toJSON())]
    return spark.createDataFrame([(nodes.count("Join"), nodes.count("Aggregate"))], "joins int, aggregates int")


@query("statement_do", "SELECT CAST(0 AS BIGINT) AS n")
def statement_do(spark, sf_dir):
    """DO evaluates and gives no rows."""
    return views(spark, sf_dir, "nation").sql("SELECT max(n_nationkey) AS m FROM nation").where("false").agg(F.count("*").alias("n"))


@query("load_data_enclosed", "SELECT CAST(n_nationkey AS INT) AS k, n_name || ';''x' AS name FROM nation")
def load_data_enclosed(spark, sf_dir):
    path = streaming.shared_folder(spark)
    files.export(table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(";'x")).alias("n")), path, ";", "'", "|", True)
    return files.load_data(spark, path, "k int, name string", ";", "'", lines="|")


# -- routines, triggers, events, cursors
@query("show_create_procedure", "SELECT 'CREATE PROCEDURE twice(IN x INT, OUT y BIGINT) BEGIN SET y = 2 * x; END' AS create_procedure, CAST(14 AS BIGINT) AS y")
def show_create_procedure(spark, sf_dir):
    routines = Routines(spark)
    routines.create("create procedure twice(x INT, OUT y BIGINT) BEGIN SET y = 2 * x; END")
    text = routines.show_create("TWICE").first()["create_procedure"]
    routines.drop("twice")
    routines.create(text)
    return routines.call("twice", 7, None).withColumn("create_procedure", F.lit(text))


@query("routine_resignal", "SELECT 'caught again' AS why")
def routine_resignal(spark, sf_dir):
    routines = Routines(spark)
    routines.create("""CREATE PROCEDURE inner_block() BEGIN
      DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT 'caught again' AS why; END;
      BEGIN
        DECLARE EXIT HANDLER FOR SQLSTATE '45000' BEGIN RESIGNAL SET MESSAGE_TEXT = 'again'; END;
        SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'first';
      END; END""")
    return routines.call("inner_block")


@query("drop_function", "SELECT 0 AS n")
def drop_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_gone(x INT) RETURNS INT RETURN x + 1")
    spark.sql("DROP TEMPORARY FUNCTION larkspur_gone")
    return spark.createDataFrame([(sum(f.name == "larkspur_gone" for f in spark.catalog.listFunctions(pattern="larkspur_gone")),)], "n int")


@query("show_triggers", "SELECT * FROM (VALUES ('b', 'INSERT', 'BEFORE'), ('c', 'DELETE', 'AFTER')) t(trigger, event, timing)")
def show_triggers(spark, sf_dir):
    t = Triggers()
    for name, time, event in (("a", "before", "insert"), ("b", "before", "insert"), ("c", "after", "delete")):
        t.create(name, time, event, lambda rows: rows)
    t.drop("a")
    return t.show(spark)


@query("event_scheduled", "SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) JOIN region ON r_regionkey = n_regionkey")
def event_scheduled(spark, sf_dir):
    views(spark, sf_dir, "nation", "region")
    events, now = Events(spark), datetime(2024, 1, 1)
    events.create("CREATE EVENT per_region ON SCHEDULE EVERY 1 HOUR DO SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name;", now)
    events.create("CREATE EVENT later ON SCHEDULE AT '2024-02-01 00:00:00' DO SELECT 1", now)
    return events.run(now)[0][1]


@query("show_events", "SELECT * FROM (VALUES ('b', 'RECURRING', TIMESTAMP '2024-01-01 02:00:00', 3600, 'ENABLED'), ('c', 'ONE TIME', NULL, NULL, 'DISABLED')) t(name, type, execute_at, interval_seconds, status)")
def show_events(spark, sf_dir):
    events, now = Events(spark), datetime(2024, 1, 1)
    for text in ("a ON SCHEDULE AT '2024-01-01' DO SELECT 1", "b ON SCHEDULE EVERY 1 HOUR STARTS '2024-01-01 01:00:00' DO SELECT 2", "c ON SCHEDULE AT '2024-01-01' DISABLE DO SELECT 3", "d ON SCHEDULE EVERY 1 DAY DO SELECT 4"):
        events.create(f"CREATE EVENT {text}", now)
    events.drop("D")
    events.run(datetime(2024, 1, 1, 1, 30))
    return events.show().drop("ends")


@query("handler_read", "SELECT * FROM (SELECT 'first' AS how, min(o_orderkey) AS o_orderkey FROM orders UNION ALL SELECT 'last', max(o_orderkey) FROM orders UNION ALL (SELECT 'next', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 1) UNION ALL (SELECT 'prev', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 2 OFFSET 1))")
def handler_read(spark, sf_dir):
    handler, rows = Handler(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey"), []
    for how, n in (("first", 1), ("next", 3), ("last", 1), ("prev", 2)):
        rows += [(how, r["o_orderkey"]) for r in handler.read(how, n)]
    handler.close()
    return spark.createDataFrame(rows, "how string, o_orderkey long")


# -- plans that read less
@query("join_bloom", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 400000")
def join_bloom(spark, sf_dir):
    """The keys that the filtered side holds go into a Bloom filter, which drops rows of the other side before they shuffle; a
    session of its own has the limits at which Spark thinks it worth while, for tables as small as these."""
    own = spark.newSession()
    for name, value in (("autoBroadcastJoinThreshold", "-1"), ("optimizer.runtime.bloomFilter.enabled", "true"), ("optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")):
        own.conf.set(f"spark.sql.{name}", value)
    few = table(own, sf_dir, "orders").where("o_totalprice > 400000").select("o_orderkey")
    return table(own, sf_dir, "lineitem").join(few, F_("l_orderkey") == F_("o_orderkey")).select("l_orderkey", "l_linenumber")


@query("scan_zones", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def scan_zones(spark, sf_dir):
    """Rows in the order of a key: row groups whose range misses the filter are not read."""
    path, orders = streaming.shared_folder(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    files.optimize(orders, path, 500, ("o_orderkey",))
    return spark.read.schema(orders.schema).parquet(path).where("o_orderkey BETWEEN 100 AND 200")


# -- key-value commands
def _groups(spark):
    return spark.createDataFrame([("click", "g", 0, 0)], "key string, grp string, last_ms long, last_seq long")


_TOPS = f"(SELECT key, max((ms, seq))[1] AS ms, max((ms, seq))[2] AS seq FROM {_STREAM} GROUP BY key)"


@query("kv_xgroup", f"SELECT key, 'g' AS grp, CASE WHEN key = 'click' THEN 0 ELSE ms END AS last_ms, CASE WHEN key = 'click' THEN 0 ELSE seq END AS last_seq FROM {_TOPS} UNION ALL SELECT key, 'h', 7, 1 FROM {_TOPS}")
def kv_xgroup(spark, sf_dir):
    s = _stream(spark, sf_dir)
    groups = kv.xgroup_create(kv.xgroup_create(kv.xgroup_create(_groups(spark), s, "g"), s, "gone"), s, "h", (5, 5))
    return kv.xgroup_destroy(kv.xgroup_setid(groups, s, "h", (7, 1)), "gone")


@query("kv_xreadgroup", f"SELECT key, ms, seq, 'c' AS consumer FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM {_STREAM}) WHERE r <= 4 OR r <= 9 AND key = 'click'")
def kv_xreadgroup(spark, sf_dir):
    s = _stream(spark, sf_dir)
    given, groups = kv.xreadgroup(s, kv.xgroup_create(_groups(spark), s, "g", (0, 0)), "g", "c", 4, F.lit(1))
    more, _ = kv.xreadgroup(s.where("key = 'click'"), groups, "g", "c", 5, F.lit(2))
    return given.union(more).select("key", "ms", "seq", "consumer")


@query("kv_xack", f"SELECT key, count(*) AS n FROM {_STREAM} WHERE fields % 3 = 0 GROUP BY key")
def kv_xack(spark, sf_dir):
    pending = _pending(spark, sf_dir)
    return kv.xack(pending, pending.where("fields % 3 = 0"))[1].select("key", "n")


@query("kv_xsetid", f"SELECT key, CASE WHEN key = 'click' THEN 99 ELSE ms END AS ms, CASE WHEN key = 'click' THEN 3 ELSE seq END AS seq FROM {_TOPS}")
def kv_xsetid(spark, sf_dir):
    last = _stream(spark, sf_dir).groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("e")).select("key", "e.*")
    return kv.xsetid(last, spark.createDataFrame([("click", 99, 3), ("none", 1, 1)], "key string, ms long, seq long"))


@query("kv_geopos", f"SELECT CAST(n_nationkey * 40 AS BIGINT) AS member, CASE WHEN c_custkey IS NOT NULL THEN CAST({_LON} AS DOUBLE) END AS lon, CASE WHEN c_custkey IS NOT NULL THEN CAST({_LAT} AS DOUBLE) END AS lat FROM nation LEFT JOIN customer ON c_custkey = n_nationkey * 40")
def kv_geopos(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.lit("c").alias("key"), (F_("n_nationkey") * 40).cast("long").alias("member"))
    return kv.geopos(_geo(spark, sf_dir), wanted).select("member", "lon", "lat")


def _databases(spark, sf_dir):
    return _kv(_strings(spark, sf_dir)).withColumn("db", F_("key") % 16)


@query("kv_select", f"SELECT key, value FROM {_STRINGS} WHERE key % 16 = 3")
def kv_select(spark, sf_dir):
    return kv.select(_databases(spark, sf_dir), 3)


@query("kv_flushdb_one", f"SELECT key, value FROM {_STRINGS} WHERE key % 16 <> 3")
def kv_flushdb_one(spark, sf_dir):
    return kv.flushdb(_databases(spark, sf_dir), 3).drop("db")


@query("kv_flushall", "SELECT CAST(0 AS BIGINT) AS n_keys")
def kv_flushall(spark, sf_dir):
    return kv.dbsize(kv.flushall(_databases(spark, sf_dir)))


@query("kv_time", "SELECT TRUE AS fits")
def kv_time(spark, sf_dir):
    return spark.range(1).select(((kv.time()["seconds"] > _START) & kv.time()["micros"].between(0, 999_999)).alias("fits"))


@query("kv_del", f"SELECT key, value FROM {_STRINGS} WHERE key NOT IN (SELECT n.key FROM {_NEWS} n)")
def kv_del(spark, sf_dir):
    return _kv(kv.delete(_strings(spark, sf_dir), _news(spark, sf_dir)))


@query("kv_decrby", "SELECT s_suppkey AS key, CAST(s_nationkey - CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE 0 END AS BIGINT) AS value FROM supplier")
def kv_decrby(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F_("s_suppkey").alias("key"), F_("s_nationkey").cast("string").alias("value"))
    return kv.incr(t, t.where("key % 2 = 0").select("key", F.lit(-7).alias("delta")), ["key"])


@query("kv_psetex", "SELECT CAST(n_nationkey * 10 + 1 AS BIGINT) AS key, CAST(1500 AS BIGINT) AS pttl FROM nation")
def kv_psetex(spark, sf_dir):
    rows = _news(spark, sf_dir)
    at = F.timestamp_millis(F.lit(_START * 1000 + 1500).cast("long")).cast("timestamp_ntz")
    return kv.pttl(kv.put(_strings(spark, sf_dir), rows.withColumn("expire_at", at), ["key"]), _now(), rows, ["key"])


@query("kv_expireat", "SELECT c_custkey AS key, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1704067300 WHEN c_custkey % 4 = 0 THEN -1 ELSE 1704067200 + (c_custkey - 50) * 10 END AS BIGINT) AS \"at\" FROM customer")
def kv_expireat(spark, sf_dir):
    t = kv.expire(_strings(spark, sf_dir), F_("key") % 3 == 0, _at(F.lit(100)))
    return kv.expiretime(t, t)


@query("kv_hpexpire", f"SELECT key, field, 1 AS done FROM {_HASH} WHERE field = 'click' UNION ALL SELECT DISTINCT key, 'none', -2 FROM {_HASH}")
def kv_hpexpire(spark, sf_dir):
    h = _hash(spark, sf_dir).withColumn("field_expire_at", F.lit(None).cast("timestamp_ntz"))
    wanted = h.where("field = 'click'").select("key", "field").union(h.select("key", F.lit("none")).distinct())
    return kv.hpexpire(h, wanted, _at(F.lit(2)))[1]


@query("kv_zrange", f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM {_ZSET}) WHERE r BETWEEN 2 AND 3")
def kv_zrange(spark, sf_dir):
    return kv.zrange(_zset(spark, sf_dir), 1, 2).select("key", "member", "score")
