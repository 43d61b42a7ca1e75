"""Queries over table modification, full-text search, key-value structures, streams and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import kv
from larkspur.catalog import query
from larkspur.operators import dml, fulltext
from larkspur.sources import table

F_ = F.col


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _delta(orders):
    return orders.where("o_orderkey % 3 = 0").select(F.when(F_("o_orderkey") % 2 == 0, F_("o_orderkey")).otherwise(F_("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


_DELTA = "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS k FROM orders WHERE o_orderkey % 3 = 0)"


def _short(df):
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("dml_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'new', NULL FROM nation WHERE n_regionkey = 1")
def dml_insert(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return dml.insert(nation, nation.where("n_regionkey = 1").select((F_("n_nationkey") + 100).alias("n_nationkey")), {"n_name": F.lit("new")})


@query("dml_insert_ignore", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT k, 'N', 1.5 FROM {_DELTA} WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def dml_insert_ignore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _short(dml.insert_ignore(orders, _delta(orders), ["o_orderkey"]))


@query("dml_replace", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT k FROM {_DELTA}) UNION ALL SELECT k, 'N', 1.5 FROM {_DELTA}")
def dml_replace(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _short(dml.replace(orders, _delta(orders), ["o_orderkey"]))


@query("dml_upsert", f"SELECT o_orderkey, o_orderstatus, CASE WHEN k IS NULL THEN o_totalprice ELSE o_totalprice + 1.5 END AS o_totalprice FROM orders LEFT JOIN {_DELTA} d ON o_orderkey = k UNION ALL SELECT k, 'N', 1.5 FROM {_DELTA} WHERE k NOT IN (SELECT o_orderkey FROM orders)")
def dml_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _short(dml.upsert(orders, _delta(orders), ["o_orderkey"], {"o_totalprice": F_("o_totalprice") + F_("new_o_totalprice")}))


@query("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark, sf_dir):
    return dml.update(table(spark, sf_dir, "customer"), F_("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}).select("c_custkey", "c_acctbal")


@query("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)")
def dml_delete(spark, sf_dir):
    return dml.delete(table(spark, sf_dir, "orders"), F.nullif(F_("o_orderstatus"), F.lit("P")) == "F").select("o_orderkey")


@query("dml_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dml_cascade(spark, sf_dir):
    return dml.cascade_delete(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal >= 0"), "c_custkey").select("o_orderkey")


@query("dml_set_null", "SELECT o_orderkey, c_custkey AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def dml_set_null(spark, sf_dir):
    return dml.set_null(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal >= 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("constraint_foreign_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def constraint_fk(spark, sf_dir):
    return dml.violations(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("constraint_check", "SELECT p_partkey FROM part WHERE NOT (p_size > 0 AND p_retailprice < 1200)")
def constraint_check(spark, sf_dir):
    return dml.check_violations(table(spark, sf_dir, "part"), (F_("p_size") > 0) & (F_("p_retailprice") < 1200)).select("p_partkey")


# -- full text
_STOP = "(" + ", ".join(f"'{w}'" for w in fulltext.STOPWORDS) + ")"
_TOKENS = f"SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN {_STOP}) AS words FROM documents"
_SEARCH = f"""WITH t AS ({_TOKENS}), p AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM t),
h AS (SELECT term, doc_id, n, count(*) AS tf FROM p WHERE term IN ('thed', 'ering') GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id AS id, round(sum(tf / n::DOUBLE * ln((SELECT count(*) FROM documents) / df::DOUBLE)), 9) AS score FROM h JOIN d USING (term) GROUP BY doc_id"""


@query("fulltext_search", _SEARCH)
def fulltext_search(spark, sf_dir):
    return fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", "thed the ering", top=None).select("id", F.round("score", 9).alias("score"))


@query("fulltext_boolean_and", _SEARCH + " HAVING count(*) = 2")
def fulltext_and(spark, sf_dir):
    return fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", "thed ering", "and", None).select("id", F.round("score", 9).alias("score"))


@query("fulltext_match", f"WITH t AS ({_TOKENS}) SELECT doc_id, round((len(list_filter(words, lambda w: w = 'thed')) + len(list_filter(words, lambda w: w = 'ering'))) / greatest(len(words), 1)::DOUBLE / 2, 9) AS score FROM t")
def fulltext_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fulltext.match_against(F_("text"), ["thed", "ering"]), 9).alias("score"))


# -- key-value structures over events: the key is the user, members are event types
def _zset(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F_("user_id").alias("key"), F_("event_type").alias("member")).agg(F.round(F.sum("value"), 4).alias("score"))


_ZSET = "(SELECT user_id AS key, event_type AS member, round(sum(value), 4) AS score FROM events GROUP BY ALL) z"


@query("kv_zrank", f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM {_ZSET}")
def kv_zrank(spark, sf_dir):
    return kv.zrank(_zset(spark, sf_dir))


@query("kv_zrange_rev", f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS r FROM {_ZSET}) WHERE r <= 2")
def kv_zrange(spark, sf_dir):
    return kv.zrange(_zset(spark, sf_dir), 0, 1, rev=True).select("key", "member")


@query("kv_zcount", f"SELECT key, count(*) FILTER (WHERE score > 10 AND score <= 100) AS n FROM {_ZSET} GROUP BY key")
def kv_zcount(spark, sf_dir):
    return kv.zcount(_zset(spark, sf_dir), "(10", "100")


@query("kv_zrangebyscore", f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM {_ZSET} WHERE score >= 5) WHERE r = 2")
def kv_zrangebyscore(spark, sf_dir):
    return kv.zrangebyscore(_zset(spark, sf_dir), "5", "+inf", 1, 1)


@query("kv_zadd_gt", f"SELECT key, member, greatest(score, 20) AS score FROM {_ZSET}")
def kv_zadd(spark, sf_dir):
    z = _zset(spark, sf_dir)
    return kv.zadd(z, z.withColumn("score", F.lit(20.0)), "gt")


@query("kv_zincrby", f"SELECT key, member, round(score + 1.5, 4) AS score FROM {_ZSET}")
def kv_zincrby(spark, sf_dir):
    z = _zset(spark, sf_dir)
    return kv.zincrby(z, z.select("key", "member", F.lit(1.5).alias("delta"))).withColumn("score", F.round("score", 4))


@query("kv_zpopmin", f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS r FROM {_ZSET}) WHERE r = 1")
def kv_zpop(spark, sf_dir):
    return kv.zpop(_zset(spark, sf_dir))[0]


def _sets(spark, sf_dir):
    return _events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("member")).distinct()


_TYPES = "SELECT DISTINCT user_id AS member FROM events WHERE event_type = '{}'"


@query("kv_sinter", _TYPES.format("click") + " INTERSECT " + _TYPES.format("purchase"))
def kv_sinter(spark, sf_dir):
    return kv.sinter(_sets(spark, sf_dir), "click", "purchase")


@query("kv_sunion", _TYPES.format("click") + " UNION " + _TYPES.format("purchase"))
def kv_sunion(spark, sf_dir):
    return kv.sunion(_sets(spark, sf_dir), "click", "purchase")


@query("kv_sdiff", _TYPES.format("click") + " EXCEPT " + _TYPES.format("purchase"))
def kv_sdiff(spark, sf_dir):
    return kv.sdiff(_sets(spark, sf_dir), "click", "purchase")


@query("kv_scard", "SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def kv_scard(spark, sf_dir):
    return _sets(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


def _lists(spark, sf_dir):
    return _events(spark, sf_dir).select(F_("user_id").alias("key"), F_("event_id").alias("pos"), F_("event_type").alias("value"))


_LISTS = "(SELECT user_id AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) l"


@query("kv_lrange", f"SELECT key, pos, value FROM {_LISTS} WHERE i BETWEEN 1 AND n - 2")
def kv_lrange(spark, sf_dir):
    return kv.lrange(_lists(spark, sf_dir), 1, -2)


@query("kv_lindex", f"SELECT key, pos, value FROM {_LISTS} WHERE i = n - 1")
def kv_lindex(spark, sf_dir):
    return kv.lindex(_lists(spark, sf_dir), -1)


@query("kv_lset", f"SELECT key, pos, CASE WHEN i = 0 THEN 'first' ELSE value END AS value FROM {_LISTS}")
def kv_lset(spark, sf_dir):
    return kv.lset(_lists(spark, sf_dir), 0, F.lit("first"))


@query("kv_rpop", f"SELECT key, pos, value FROM {_LISTS} WHERE i >= n - 2")
def kv_rpop(spark, sf_dir):
    return kv.pop(_lists(spark, sf_dir), 2, left=False)[0]


@query("kv_lpos", f"SELECT key, min(i) AS place FROM {_LISTS} WHERE value = 'click' GROUP BY key")
def kv_lpos(spark, sf_dir):
    return kv.lpos(_lists(spark, sf_dir), "click")


@query("kv_rpush", f"SELECT key, pos, value FROM {_LISTS} UNION ALL SELECT user_id, max(event_id) + 1, 'end' FROM events GROUP BY user_id")
def kv_rpush(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return kv.push(lists, lists.select("key").distinct().select("key", F.lit(1).alias("ord"), F.lit("end").alias("value")))


def _hash(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F_("user_id").alias("key"), F_("event_type").alias("field")).agg(F.count("*").alias("value"))


_HASH = "(SELECT user_id AS key, event_type AS field, count(*) AS value FROM events GROUP BY ALL) h"


@query("kv_hincrby", f"SELECT key, field, CAST(value + 5 AS BIGINT) AS value FROM {_HASH}")
def kv_hincrby(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return kv.incr(h, h.select("key", "field", F.lit(5).alias("delta")), ["key", "field"])


@query("kv_hlen", f"SELECT key, count(*) AS n FROM {_HASH} GROUP BY key")
def kv_hlen(spark, sf_dir):
    return _hash(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


@query("kv_hgetall", f"SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM {_HASH} GROUP BY key")
def kv_hgetall(spark, sf_dir):
    got = kv.hgetall(_hash(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select("key", F.array_join(pairs, ",").alias("fields"))


@query("kv_getrange", "SELECT c_custkey AS key, substr(c_name, 2, greatest(length(c_name) - 2, 0)) AS v FROM customer")
def kv_getrange(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F_("c_custkey").alias("key"), kv.getrange(F_("c_name"), 1, -2).alias("v"))


@query("kv_keys", "SELECT DISTINCT c_name AS key FROM customer WHERE regexp_matches(c_name, '^Customer.*[13]$')")
def kv_keys(spark, sf_dir):
    return kv.keys(table(spark, sf_dir, "customer").select(F_("c_name").alias("key")), "Customer*[13]")


@query("kv_ttl", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE CAST(o_orderkey * 10 AS BIGINT) END AS ttl FROM orders")
def kv_ttl(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    t = table(spark, sf_dir, "orders").select(F_("o_orderkey").alias("key"), F.when(F_("o_orderkey") % 4 != 0, F.timestamp_seconds(F.lit(1704067200) + F_("o_orderkey") * 10).cast("timestamp_ntz")).alias("expire_at"))
    return kv.ttl(t, now, t)


def _stream(spark, sf_dir):
    ms = F.floor(F.unix_micros(F_("ts").cast("timestamp")) / 60_000_000).cast("long")
    return kv.xadd(_events(spark, sf_dir).select(F_("event_type").alias("key"), ms.alias("ms"), F_("event_id").alias("ord"), F_("event_id").alias("fields")))


_STREAM = "(SELECT event_type AS key, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS ms, row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts) / 60000000) ORDER BY event_id) - 1 AS seq, event_id AS fields FROM events) s"


@query("kv_xadd", f"SELECT * FROM {_STREAM}")
def kv_xadd(spark, sf_dir):
    return _stream(spark, sf_dir)


@query("kv_xtrim", f"SELECT key, ms, seq, fields FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM {_STREAM}) WHERE r <= 20")
def kv_xtrim(spark, sf_dir):
    return kv.xtrim(_stream(spark, sf_dir), 20)


@query("kv_xinfo", f"SELECT key, count(*) AS length, min((ms, seq))[1] || '-' || min((ms, seq))[2] AS first_id, max((ms, seq))[1] || '-' || max((ms, seq))[2] AS last_id FROM {_STREAM} GROUP BY key")
def kv_xinfo(spark, sf_dir):
    return kv.xinfo(_stream(spark, sf_dir))


@query("kv_xpending", f"SELECT key, count(*) AS n FROM {_STREAM} WHERE fields % 3 <> 0 GROUP BY key")
def kv_xpending(spark, sf_dir):
    delivered = _stream(spark, sf_dir).select("key", F.lit("g").alias("grp"), "ms", "seq", F.lit("c1").alias("consumer"), "fields")
    return kv.xpending(delivered, delivered.where("fields % 3 = 0").select("key", "grp", "ms", "seq")).groupBy("key").agg(F.count("*").alias("n"))


@query("kv_pfcount")
def kv_pfcount(spark, sf_dir):
    return kv.pfcount(kv.pfadd(_events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("value"))))


@query("kv_bitop", "SELECT DISTINCT user_id AS bit FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def kv_bitop(spark, sf_dir):
    return kv.bitop("and", _events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("bit")), "click", "purchase")


@query("kv_bitcount", "SELECT event_type AS key, count(DISTINCT user_id) FILTER (WHERE user_id BETWEEN 8 AND 63) AS n FROM events WHERE user_id BETWEEN 8 AND 63 GROUP BY event_type")
def kv_bitcount(spark, sf_dir):
    return kv.bitcount(_events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("bit")), 1, 7)


_LON, _LAT = "((c_custkey * 37) % 360 - 180)", "((c_custkey * 17) % 160 - 80)"
_HAV = f"2 * 6372797.560856::DOUBLE * asin(sqrt(pow(sin((radians(10.0::DOUBLE) - radians({_LAT}::DOUBLE)) / 2), 2) + cos(radians({_LAT}::DOUBLE)) * cos(radians(10.0::DOUBLE)) * pow(sin((radians(20.0::DOUBLE) - radians({_LON}::DOUBLE)) / 2), 2)))"


def _geo(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("'c' AS key", "c_custkey AS member", f"CAST({_LON} AS DOUBLE) AS lon", f"CAST({_LAT} AS DOUBLE) AS lat")


@query("kv_geodist", f"SELECT c_custkey AS member, round({_HAV} / 1000, 4) AS km FROM customer")
def kv_geodist(spark, sf_dir):
    return _geo(spark, sf_dir).select("member", F.round(kv.geodist(F_("lon"), F_("lat"), F.lit(20.0), F.lit(10.0), "km"), 4).alias("km"))


@query("kv_geosearch", f"SELECT c_custkey AS member FROM customer WHERE {_HAV} <= 3000000")
def kv_geosearch(spark, sf_dir):
    return kv.geosearch(_geo(spark, sf_dir), 20.0, 10.0, 3000, "km").select("member")
