"""Queries over procedures with control flow, handlers and signals, and triggers."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.catalog import query
from larkspur.operators.routines import Routines, Triggers
from larkspur.sources import table, views

F_ = F.col


def _call(spark, sf_dir, text: str, *arguments, tables=("orders", "nation", "region", "supplier")):
    views(spark, sf_dir, *tables)
    routines = Routines(spark)
    return routines.call(routines.create(text).name, *arguments)


@query("routine_out", "SELECT count(*) AS n, CAST(max(n_nationkey) AS BIGINT) AS top FROM nation WHERE n_regionkey = 2")
def routine_out(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE nations(IN region INT, OUT n BIGINT, OUT top BIGINT) BEGIN SET (n, top) = (SELECT count(*), max(n_nationkey) FROM nation WHERE n_regionkey = region); END", 2, None, None)


@query("routine_inout", "SELECT CAST(count(*) + 5 AS BIGINT) AS total FROM region")
def routine_inout(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE add_regions(INOUT total BIGINT) BEGIN SET total = total + (SELECT count(*) FROM region); END", 5)


@query("routine_if", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'other' END AS kind FROM nation WHERE n_nationkey = 3")
def routine_if(spark, sf_dir):
    text = """CREATE PROCEDURE kind_of(IN k INT) BEGIN
      DECLARE kind STRING; DECLARE r INT;
      SET r = (SELECT n_regionkey FROM nation WHERE n_nationkey = k);
      IF r = 1 THEN SET kind = 'one'; ELSEIF r IS NULL THEN SET kind = 'none'; ELSE SET kind = 'other'; END IF;
      SELECT n_name, kind AS kind FROM nation WHERE n_nationkey = k; END"""
    return _call(spark, sf_dir, text, 3)


@query("routine_while", "SELECT CAST(5 * 4 * 3 * 2 AS BIGINT) AS f")
def routine_while(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE factorial(IN k INT, OUT f BIGINT) BEGIN SET f = 1; WHILE k > 1 DO SET f = f * k; SET k = k - 1; END WHILE; END", 5, None)


@query("routine_repeat", "SELECT CAST(128 AS BIGINT) AS v")
def routine_repeat(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE doubling(IN least BIGINT, OUT v BIGINT) BEGIN SET v = 1; REPEAT SET v = v * 2; UNTIL v >= least END REPEAT; END", 100, None)


@query("routine_loop", "SELECT CAST(sum(i) AS BIGINT) AS v FROM range(1, 11) t(i) WHERE i % 3 <> 0")
def routine_loop(spark, sf_dir):
    text = """CREATE PROCEDURE odd_sum(OUT v BIGINT) BEGIN
      DECLARE i INT DEFAULT 0; SET v = 0;
      again: LOOP SET i = i + 1;
        IF i > 10 THEN LEAVE again; END IF;
        IF i % 3 = 0 THEN ITERATE again; END IF;
        SET v = v + i;
      END LOOP again; END"""
    return _call(spark, sf_dir, text, None)


@query("routine_cursor", "SELECT string_agg(r_name, '>' ORDER BY r_regionkey) AS names FROM region")
def routine_cursor(spark, sf_dir):
    text = "CREATE PROCEDURE chain(OUT names STRING) BEGIN FOR r AS SELECT r_name FROM region ORDER BY r_regionkey DO SET names = concat_ws('>', names, r.r_name); END FOR; END"
    return _call(spark, sf_dir, text, None)


@query("routine_handler", "SELECT -1 AS v")
def routine_handler(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE careful(IN d INT) BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SELECT -1 AS v; END; SELECT 10 / d AS v; END", 0)


@query("routine_signal", "SELECT 'too many' AS why")
def routine_signal(spark, sf_dir):
    text = """CREATE PROCEDURE refuse(IN n INT) BEGIN
      DECLARE EXIT HANDLER FOR SQLSTATE '45000' BEGIN SELECT 'too many' AS why; END;
      IF n > 3 THEN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'too many'; END IF;
      SELECT 'fine' AS why; END"""
    return _call(spark, sf_dir, text, 4)


@query("routine_case", "SELECT n_regionkey AS k, CASE n_regionkey WHEN 0 THEN 'zero' ELSE 'more' END AS v FROM nation WHERE n_nationkey = 0")
def routine_case(spark, sf_dir):
    text = """CREATE PROCEDURE named(IN n INT) BEGIN DECLARE k INT; DECLARE v STRING;
      SET k = (SELECT n_regionkey FROM nation WHERE n_nationkey = n);
      CASE k WHEN 0 THEN SET v = 'zero'; ELSE SET v = 'more'; END CASE; SELECT k AS k, v AS v; END"""
    return _call(spark, sf_dir, text, 0)


@query("routine_set_based", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def routine_set_based(spark, sf_dir):
    return _call(spark, sf_dir, "CREATE PROCEDURE customers(IN least DOUBLE) BEGIN SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > least GROUP BY o_custkey; END", 1000)


@query("routine_status", "SELECT * FROM (VALUES ('a', 1, 'x', 'IN'), ('a', 2, 'y', 'OUT'), ('b', 0, NULL, NULL)) t(routine_name, ordinal_position, parameter_name, parameter_mode)")
def routine_status(spark, sf_dir):
    routines = Routines(spark)
    for text in ("CREATE PROCEDURE a(IN x INT, OUT y DECIMAL(10, 2)) BEGIN SET y = x; END", "CREATE PROCEDURE b() BEGIN SELECT 1; END", "CREATE PROCEDURE c() BEGIN SELECT 1; END"):
        routines.create(text)
    routines.drop("C")
    return routines.show().select("routine_name", "ordinal_position", "parameter_name", "parameter_mode")


@query("trigger_before_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, upper(n_name) FROM nation")
def trigger_before_insert(spark, sf_dir):
    t = Triggers()
    t.create("shout", "before", "insert", lambda rows: rows.withColumn("r_name", F.upper("r_name")))
    rows = table(spark, sf_dir, "nation").select((F_("n_nationkey") + 100).alias("r_regionkey"), F_("n_name").alias("r_name"))
    return t.insert(table(spark, sf_dir, "region"), rows)[0]


@query("trigger_before_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN greatest(c_acctbal - 500, -800) ELSE c_acctbal END AS c_acctbal FROM customer")
def trigger_before_update(spark, sf_dir):
    t = Triggers()
    t.create("floor", "before", "update", lambda rows: rows.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(-800.0))))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return t.update(customer, F_("c_acctbal") < 0, {"c_acctbal": F_("c_acctbal") - 500})[0]


@query("trigger_after_delete", "SELECT s_suppkey, s_name, 'gone' AS what FROM supplier WHERE s_acctbal < 0")
def trigger_after_delete(spark, sf_dir):
    t = Triggers()
    t.create("log", "after", "delete", lambda rows: rows.select("s_suppkey", "s_name", F.lit("gone").alias("what")))
    return t.delete(table(spark, sf_dir, "supplier"), F_("s_acctbal") < 0)[1][0]
