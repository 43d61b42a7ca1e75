"""Further key-value commands, partition routing, and the other modes of full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import kv
from larkspur.catalog import query
from larkspur.operators import fulltext, partitions
from larkspur.plans.keyvalue import _NEWS, _START, _STRINGS, _at, _kv, _news, _now, _strings
from larkspur.plans.tables import _HASH, _SEARCH, _TOKENS, _geo, _hash, _sets
from larkspur.sources import table

F_ = F.col
_LEFT = "CASE WHEN n.key NOT IN (SELECT c_custkey FROM customer) THEN -2 WHEN n.key % 4 = 0 THEN -1 ELSE {} END"


@query("kv_getset", f"SELECT n.key, s.value FROM {_NEWS} n LEFT JOIN {_STRINGS} ON n.key = s.key")
def kv_getset(spark, sf_dir):
    return kv.getset(_strings(spark, sf_dir), _news(spark, sf_dir))[1]


@query("kv_set_keepttl", f"SELECT coalesce(n.key, s.key) AS key, coalesce(n.value, s.value) AS value, n.key IS NULL AND s.key % 4 = 0 OR s.key IS NULL OR s.key % 4 = 0 AS forever FROM {_STRINGS} FULL JOIN {_NEWS} n ON n.key = s.key")
def kv_set_keepttl(spark, sf_dir):
    return kv.set_keepttl(_strings(spark, sf_dir), _news(spark, sf_dir)).select("key", "value", F_("expire_at").isNull().alias("forever"))


@query("kv_getex", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 30 WHEN c_custkey % 4 = 0 THEN -1 ELSE (c_custkey - 50) * 10 END AS ttl FROM customer")
def kv_getex(spark, sf_dir):
    t = kv.expire(_strings(spark, sf_dir), F_("key") % 2 == 0, _at(F.lit(30)))
    return kv.ttl(t, _now(), t)


@query("kv_pttl", f"SELECT n.key, CAST({_LEFT.format('(n.key - 50) * 10000')} AS BIGINT) AS pttl FROM {_NEWS} n")
def kv_pttl(spark, sf_dir):
    return kv.pttl(_strings(spark, sf_dir), _now(), _news(spark, sf_dir), ["key"])


@query("kv_expiretime", f"SELECT n.key, CAST({_LEFT.format(f'{_START} + (n.key - 50) * 10')} AS BIGINT) AS \"at\" FROM {_NEWS} n")
def kv_expiretime(spark, sf_dir):
    return kv.expiretime(_strings(spark, sf_dir), _news(spark, sf_dir))


@query("kv_flushdb", "SELECT CAST(0 AS BIGINT) AS n_keys")
def kv_flushdb(spark, sf_dir):
    t = _strings(spark, sf_dir)
    return kv.dbsize(kv.delete(t, t))


@query("kv_hexists", f"SELECT h.key, 'click' AS field, CAST(bool_or(h.field = 'click') AS INT) AS there FROM {_HASH} GROUP BY h.key" if _HASH.rstrip().endswith(" h") else f"SELECT key, 'click' AS field, CAST(bool_or(field = 'click') AS INT) AS there FROM {_HASH} GROUP BY key")
def kv_hexists(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return kv.hexists(h, h.select("key", F.lit("click").alias("field")).distinct())


@query("kv_hincrbyfloat", f"SELECT key, field, round(value + 0.25, 4) AS value FROM {_HASH}")
def kv_hincrbyfloat(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return kv.incr(h, h.select("key", "field", F.lit(0.25).alias("delta")), ["key", "field"], kind="double").withColumn("value", F.round("value", 4))


def _expiring(spark, sf_dir):
    return _hash(spark, sf_dir).withColumn("field_expire_at", F.when(F_("value") > 1, _at(F_("value"))))


@query("kv_hpttl", f"SELECT key, field, CAST(CASE WHEN value > 1 THEN value * 1000 ELSE -1 END AS BIGINT) AS pttl FROM {_HASH}")
def kv_hpttl(spark, sf_dir):
    h = _expiring(spark, sf_dir)
    return kv.pttl(h, _now(), h, ["key", "field"], "field_expire_at")


@query("kv_httl", f"SELECT key, field, CAST(CASE WHEN value > 1 THEN value ELSE -1 END AS BIGINT) AS ttl FROM {_HASH}")
def kv_httl(spark, sf_dir):
    h = _expiring(spark, sf_dir)
    return kv.pttl(h, _now(), h, ["key", "field"], "field_expire_at").select("key", "field", F.when(F_("pttl") < 0, F_("pttl")).otherwise(F.ceil(F_("pttl") / 1000)).alias("ttl"))


@query("kv_hpersist", f"SELECT key, field, CAST(CASE WHEN value > 1 AND field <> 'click' THEN value * 1000 ELSE -1 END AS BIGINT) AS pttl FROM {_HASH}")
def kv_hpersist(spark, sf_dir):
    h = _expiring(spark, sf_dir).withColumn("field_expire_at", F.when(F_("field") != "click", F_("field_expire_at")))
    return kv.pttl(h, _now(), h, ["key", "field"], "field_expire_at")


@query("kv_spop", "SELECT key, count(*) AS n, greatest(count(*) - 3, 0) AS stay FROM (SELECT DISTINCT event_type AS key, user_id AS member FROM events) GROUP BY key")
def kv_spop(spark, sf_dir):
    stay, taken = kv.spop(_sets(spark, sf_dir), 3)
    both = stay.withColumn("stays", F.lit(1)).unionByName(taken.withColumn("stays", F.lit(0))).distinct()
    return both.groupBy("key").agg(F.count("*").alias("n"), F.sum("stays").alias("stay"))


@query("kv_geosearch_box")
def kv_geosearch_box(spark, sf_dir):
    return kv.geosearch_box(_geo(spark, sf_dir), 0.0, 0.0, 6000, 4000, "km")


# -- partitions
@query("partition_key", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, TRUE AS one_place FROM orders")
def partition_key(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").select("o_custkey", partitions.by_key(F_("o_custkey"), n=8).alias("p"))
    each = placed.groupBy("o_custkey").agg(F.count("*").alias("n"), (F.min("p") == F.max("p")).alias("one"))
    return each.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.every("one").alias("one_place"))


@query("partition_linear_hash", "SELECT o_orderkey, CAST(CASE WHEN (o_orderkey & 7) >= 6 THEN o_orderkey & 3 ELSE o_orderkey & 7 END AS INT) AS part_no FROM orders")
def partition_linear_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", partitions.by_linear_hash(F_("o_orderkey"), 6).alias("part_no"))


@query("partition_range_columns", "SELECT p_partkey, CASE WHEN (p_brand, p_size) < ('Brand#2', 10) THEN 0 WHEN (p_brand, p_size) < ('Brand#4', 25) THEN 1 ELSE 2 END AS part_no FROM part")
def partition_range_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", partitions.by_range_columns([F_("p_brand"), F_("p_size")], [("Brand#2", 10), ("Brand#4", 25), None]).alias("part_no"))


# -- full text
@query("fulltext_top", f"{_SEARCH} ORDER BY score DESC, id LIMIT 100")
def fulltext_top(spark, sf_dir):
    return fulltext.search(table(spark, sf_dir, "documents"), "doc_id", "text", "thed the ering").select("id", F.round("score", 9).alias("score"))


@query("fulltext_index", f"WITH t AS ({_TOKENS}), p AS (SELECT doc_id AS id, len(words) AS length, unnest(words) AS term FROM t) SELECT term, id, CAST(length AS INT) AS length, count(*) AS tf FROM p GROUP BY ALL")
def fulltext_index(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("fulltext_match_boolean", f"WITH t AS ({_TOKENS}), c AS (SELECT doc_id, len(words) AS n, len(list_filter(words, lambda w: w = 'thed')) AS a, len(list_filter(words, lambda w: w = 'ering')) AS b FROM t) SELECT doc_id, round(CASE WHEN a > 0 AND b > 0 THEN (a + b) / n::DOUBLE / 2 ELSE 0 END, 9) AS score FROM c")
def fulltext_match_boolean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fulltext.match_against(F_("text"), ["thed", "ering"], True), 9).alias("score"))


@query("fulltext_expansion")
def fulltext_expansion(spark, sf_dir):
    return fulltext.expand(table(spark, sf_dir, "documents"), "doc_id", "text", "thed ering")
