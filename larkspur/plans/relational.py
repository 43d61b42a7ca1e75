"""Relational queries: projection, predicates, joins, aggregation, windows, sorting, set operations, CTEs.

Where Spark SQL and the oracle's dialect agree, one text is both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.catalog import query
from larkspur.functions import json as J
from larkspur.operators import interval, ranking
from larkspur.operators.subqueries import compare_all, compare_any
from larkspur.sources import TABLES, files, table, views


def sql(name: str, text: str, oracle: str | None = None) -> None:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    query(name, oracle or text)(lambda spark, sf_dir: views(spark, sf_dir, *names).sql(text))


@query(
    "q01_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
              round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


# -- scans, projection, predicates
sql("scan_projection", "SELECT p_partkey, p_name, p_size * 2 AS double_size FROM part")
sql("scan_star", "SELECT n.* FROM nation n")
sql("scan_dual", "SELECT 1 AS one, 'x' AS x")
sql("scan_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
sql("scan_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_quantity < 48")
sql("filter_logic", "SELECT p_partkey FROM part WHERE (p_size > 10 AND NOT p_size > 30) OR p_brand = 'Brand#11'")
sql("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1100")
sql("filter_like", "SELECT p_partkey FROM part WHERE p_name ILIKE '%a%' AND p_type NOT ILIKE '%z%'")
sql("filter_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL")
sql("filter_case", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS building FROM customer")
sql("filter_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("filter_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("filter_in_subquery", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql("filter_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql("scalar_subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")


@query("quantified_all", "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 5)")
def quantified_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return compare_all(part, "p_retailprice", ">", part.where("p_size < 5"), "p_retailprice").select("p_partkey")


@query("quantified_any", "SELECT p_partkey FROM part WHERE p_size <= ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def quantified_any(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    return compare_any(part, "p_size", "<=", nation.where("n_regionkey = 2"), "n_nationkey").select("p_partkey")


@query("quantified_some_equal", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT n_nationkey FROM nation)")
def quantified_some_equal(spark, sf_dir):
    return compare_any(table(spark, sf_dir, "part"), "p_size", "=", table(spark, sf_dir, "nation"), "n_nationkey").select("p_partkey")


@query("quantified_not_all", "SELECT p_partkey FROM part WHERE p_size <> ALL (SELECT n_nationkey FROM nation)")
def quantified_not_all(spark, sf_dir):
    return compare_all(table(spark, sf_dir, "part"), "p_size", "<>", table(spark, sf_dir, "nation"), "n_nationkey").select("p_partkey")


# -- joins
sql("join_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
sql("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
sql("join_full", "SELECT s_suppkey, n_name, n_nationkey FROM supplier FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural", "SELECT n_nationkey, n_name, r_name FROM (SELECT n_nationkey, n_name, n_regionkey AS r_regionkey FROM nation) a NATURAL JOIN region")
sql("join_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
sql("join_theta", "SELECT a.n_name AS low, b.n_name AS high, r_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey - 3 JOIN region ON r_regionkey BETWEEN a.n_regionkey AND b.n_regionkey")
sql("join_comma", "SELECT s_suppkey, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey")


@query("join_band", "SELECT a.p_partkey AS low, b.p_partkey AS high FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_retailprice BETWEEN a.p_retailprice AND a.p_retailprice + 2 AND a.p_partkey <> b.p_partkey")
def join_band(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    low = part.select("p_brand", F.col("p_partkey").alias("low"), F.col("p_retailprice").alias("price"))
    high = part.select("p_brand", F.col("p_partkey").alias("high"), F.col("p_retailprice").alias("other"))
    return interval.band_join(low, high, ["p_brand"], "price", "other", 0.0, 2.0).where("low <> high").select("low", "high")


_ASOF = "SELECT e.event_id, c.event_id AS before FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) c ON e.user_id = c.user_id AND e.ts >= c.ts"


@query("join_asof", _ASOF)
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("before"))
    return interval.asof_join(events, clicks, ["user_id"], "ts", ["before"]).select("event_id", "before")


sql("join_semi", "SELECT s_suppkey FROM supplier LEFT SEMI JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1", "SELECT s_suppkey FROM supplier SEMI JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1")
sql("join_anti", "SELECT doc_id FROM documents LEFT ANTI JOIN labels USING (doc_id)", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
sql("join_multi", "SELECT r_name, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_null_safe", "SELECT a.n_name AS x, b.n_name AS y FROM (SELECT nullif(n_regionkey, 1) AS k, n_name FROM nation) a JOIN (SELECT nullif(n_regionkey, 1) AS k, n_name FROM nation) b ON a.k <=> b.k", "SELECT a.n_name AS x, b.n_name AS y FROM (SELECT nullif(n_regionkey, 1) AS k, n_name FROM nation) a JOIN (SELECT nullif(n_regionkey, 1) AS k, n_name FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
sql("join_hash", "SELECT /*+ SHUFFLE_HASH(orders) */ l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_totalprice > l_extendedprice * 5")
sql("join_lateral", "SELECT c_custkey, top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) t")

# -- aggregation
sql("agg_global", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
sql("agg_empty", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_group_concat", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("agg_group_concat_distinct", "SELECT o_orderstatus, listagg(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
sql("agg_bits", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
sql("agg_bits_empty", "SELECT coalesce(bit_and(n_nationkey), -1) AS a, coalesce(bit_or(n_nationkey), 0) AS o, coalesce(bit_xor(n_nationkey), 0) AS x FROM nation WHERE n_nationkey < 0")
sql("agg_statistics", "SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs FROM lineitem GROUP BY l_linestatus")
sql("agg_any_value", "SELECT n_regionkey, count(*) AS n, any_value(CASE WHEN n_regionkey > 1 THEN 'late' ELSE 'early' END) AS v FROM nation GROUP BY n_regionkey")
sql("agg_count_nullable", "SELECT source, count(lang) AS langs, count(*) AS n, count(DISTINCT lang) AS kinds FROM documents GROUP BY source")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS gf, grouping(l_linestatus) AS gs, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS gf, CAST(grouping(l_linestatus) AS TINYINT) AS gs, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderstatus")
sql("agg_expression", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit FROM lineitem GROUP BY l_returnflag")
sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("agg_json_arrayagg", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey) || ']' AS names FROM nation GROUP BY n_regionkey")
def json_arrayagg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.arrayagg(F.col("n_name"), "string", F.col("n_nationkey")).alias("names"))


@query("agg_json_objectagg", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def json_objectagg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.objectagg(F.col("n_name"), F.col("n_nationkey"), "int").alias("o"))


@query("agg_approx_distinct")
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"))


# -- windows: frames are always stated
_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_FULL = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_RUN = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
sql("window_row_number", f"SELECT o_orderkey, row_number() {_OVER} AS n FROM orders", f"SELECT o_orderkey, CAST(row_number() {_OVER} AS INT) AS n FROM orders")
_BY = "OVER (PARTITION BY l_returnflag ORDER BY l_quantity)"


@query("window_rank", f"SELECT l_orderkey, l_linenumber, CAST(rank() {_BY} AS INT) AS r, CAST(dense_rank() {_BY} AS INT) AS d FROM lineitem")
def window_rank(spark, sf_dir):
    rows = ranking.rank_by_value(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")
    return rows.selectExpr("l_orderkey", "l_linenumber", "rank AS r", "dense_rank AS d")


sql("window_ntile", f"SELECT o_orderkey, ntile(4) {_OVER} AS t FROM orders", f"SELECT o_orderkey, CAST(ntile(4) {_OVER} AS INT) AS t FROM orders")
sql("window_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {_OVER} AS before, lead(o_orderkey, 2, -1) {_OVER} AS after2 FROM orders", f"SELECT o_orderkey, lag(o_orderkey) {_OVER} AS before, lead(o_orderkey, 2, -1) {_OVER} AS after2 FROM orders")
sql("window_first_last", f"SELECT o_orderkey, first_value(o_orderkey) {_FULL} AS f, last_value(o_orderkey) {_FULL} AS l, nth_value(o_orderkey, 3) {_FULL} AS third FROM orders")


@query("window_distribution", f"SELECT l_orderkey, l_linenumber, round(cume_dist() {_BY}, 9) AS c, round(percent_rank() {_BY}, 9) AS p FROM lineitem")
def window_distribution(spark, sf_dir):
    rows = ranking.rank_by_value(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")
    return rows.selectExpr("l_orderkey", "l_linenumber", "round(cume_dist, 9) AS c", "round(percent_rank, 9) AS p")


sql("window_running", f"SELECT o_orderkey, round(sum(o_totalprice) {_RUN}, 2) AS s, round(avg(o_totalprice) {_RUN}, 4) AS a, min(o_totalprice) {_RUN} AS lo, max(o_totalprice) {_RUN} AS hi, count(*) {_RUN} AS n FROM orders")
sql("window_frame_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
sql("window_frame_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
sql("window_named", "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey)")


@query("window_group_total", "SELECT c_custkey, round(sum(c_acctbal) OVER w, 2) AS s FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def window_group_total(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ranking.with_group_total(rows, "c_mktsegment", F.round(F.sum("c_acctbal"), 2), "s").select("c_custkey", "s")


# -- sort, limit, top-k
sql("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
sql("sort_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey LIMIT 7 OFFSET 3")
sql("sort_expression", "SELECT p_partkey FROM part ORDER BY p_size % 7 DESC, p_partkey LIMIT 25")
sql("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n <= 3")

# -- set operations
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")
sql("set_precedence", "SELECT r_regionkey AS k FROM region UNION SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")

# -- CTEs and derived tables
sql("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT k, n FROM a JOIN b ON n = m")
sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1 AS n, CAST(1 AS BIGINT) AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("cte_hierarchy", "WITH RECURSIVE t(name, depth) AS (SELECT r_name, 0 FROM region UNION ALL SELECT n_name, depth + 1 FROM t JOIN region ON r_name = name JOIN nation ON n_regionkey = r_regionkey WHERE depth < 1) SELECT name, depth FROM t")
sql("derived_table", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 1")


@query("view_expansion", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def view_expansion(spark, sf_dir):
    views(spark, sf_dir, "customer").sql("SELECT * FROM customer WHERE c_acctbal > 0").createOrReplaceTempView("rich_customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM rich_customer WHERE c_mktsegment = 'BUILDING'")


@query("sql_function", "SELECT p_partkey, p_size * p_size + 1 AS v FROM part")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION larkspur_area(x INT) RETURNS INT RETURN x * x + 1")
    return views(spark, sf_dir, "part").sql("SELECT p_partkey, larkspur_area(p_size) AS v FROM part")


@query("prepared_statement", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_brand = 'Brand#12'")
def prepared(spark, sf_dir):
    views(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey FROM part WHERE p_size > :size AND p_brand = :brand", args={"size": 40, "brand": "Brand#12"})


@query("handler_cursor", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS pos FROM orders WHERE o_custkey = 1")
def handler(spark, sf_dir):
    own = table(spark, sf_dir, "orders").where("o_custkey = 1")
    return own.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"))


_NATION_ROW = "concat_ws('|', n_nationkey, n_name, n_regionkey)"


@query("checksum_table", f"SELECT count(*) AS n, CAST(bit_xor(CAST('0x' || substr(md5({_NATION_ROW}), 1, 15) AS BIGINT)) AS BIGINT) AS checksum FROM nation")
def checksum(spark, sf_dir):
    return files.checksum(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
