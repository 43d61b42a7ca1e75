"""More queries over key-value structures: keyed strings, expiry, fields, lists, members, pending entries, bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur import kv
from larkspur.catalog import query
from larkspur.plans.tables import _HASH, _LISTS, _STREAM, _TYPES, _ZSET, _events, _geo, _hash, _lists, _sets, _stream, _zset
from larkspur.sources import table

F_ = F.col
_START = 1704067200


def _now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def _at(seconds):
    return F.timestamp_seconds(F.lit(_START) + seconds).cast("timestamp_ntz")


def _strings(spark, sf_dir):
    key = F_("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("key"), F_("c_name").alias("value"), F.when(key % 4 != 0, _at((key - 50) * 10)).alias("expire_at"))


def _news(spark, sf_dir):
    return table(spark, sf_dir, "nation").select((F_("n_nationkey") * 10 + 1).cast("long").alias("key"), F_("n_name").alias("value"), F.lit(None).cast("timestamp_ntz").alias("expire_at"))


_STRINGS = "(SELECT c_custkey AS key, c_name AS value FROM customer) s"
_NEWS = "(SELECT CAST(n_nationkey * 10 + 1 AS BIGINT) AS key, n_name AS value FROM nation)"


def _kv(df):
    return df.select("key", "value")


# -- strings
@query("kv_get", "SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 4 = 0 OR c_custkey > 50")
def kv_get(spark, sf_dir):
    return _kv(kv.live(_strings(spark, sf_dir), _now()))


@query("kv_mget", f"SELECT n.key, s.value FROM {_NEWS} n LEFT JOIN {_STRINGS} ON n.key = s.key")
def kv_mget(spark, sf_dir):
    return kv.mget(_strings(spark, sf_dir), _news(spark, sf_dir).select("key"), ["key"])


@query("kv_set_nx", f"SELECT key, value FROM {_STRINGS} UNION ALL SELECT key, value FROM {_NEWS} WHERE key NOT IN (SELECT c_custkey FROM customer)")
def kv_set_nx(spark, sf_dir):
    return _kv(kv.put(_strings(spark, sf_dir), _news(spark, sf_dir), ["key"], "nx"))


@query("kv_set_xx", f"SELECT s.key, coalesce(n.value, s.value) AS value FROM {_STRINGS} LEFT JOIN {_NEWS} n ON n.key = s.key")
def kv_set_xx(spark, sf_dir):
    return _kv(kv.put(_strings(spark, sf_dir), _news(spark, sf_dir), ["key"], "xx"))


@query("kv_mset", f"SELECT coalesce(n.key, s.key) AS key, coalesce(n.value, s.value) AS value FROM {_STRINGS} FULL JOIN {_NEWS} n ON n.key = s.key")
def kv_mset(spark, sf_dir):
    return _kv(kv.put(_strings(spark, sf_dir), _news(spark, sf_dir), ["key"]))


@query("kv_set_ifeq", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS value FROM customer")
def kv_set_ifeq(spark, sf_dir):
    t = _strings(spark, sf_dir)
    rows = t.select("key", F.lit("new").alias("value"), F.when(F_("key") % 2 == 0, F_("value")).otherwise("other").alias("expected"))
    return _kv(kv.set_if(t, rows, ["key"]))


@query("kv_set_ifne", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 1 THEN 'new' ELSE c_name END AS value FROM customer")
def kv_set_ifne(spark, sf_dir):
    t = _strings(spark, sf_dir)
    rows = t.select("key", F.lit("new").alias("value"), F.when(F_("key") % 2 == 0, F_("value")).otherwise("other").alias("expected"))
    return _kv(kv.set_if(t, rows, ["key"], equal=False))


@query("kv_setex", "SELECT n_nationkey * 10 + 1 AS key, 60 AS ttl FROM nation")
def kv_setex(spark, sf_dir):
    rows = _news(spark, sf_dir)
    t = kv.put(_strings(spark, sf_dir), rows.withColumn("expire_at", _at(F.lit(60))), ["key"])
    return kv.ttl(t, _now(), rows)


@query("kv_getdel", f"SELECT key, value FROM {_STRINGS} WHERE key NOT IN (SELECT key FROM {_NEWS})")
def kv_getdel(spark, sf_dir):
    return _kv(kv.delete(_strings(spark, sf_dir), _news(spark, sf_dir)))


@query("kv_incrby", "SELECT s_suppkey AS key, CAST(s_nationkey + 3 AS BIGINT) AS value FROM supplier")
def kv_incrby(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F_("s_suppkey").alias("key"), F_("s_nationkey").cast("string").alias("value"))
    return kv.incr(t, t.select("key", F.lit(3).alias("delta")), ["key"])


@query("kv_incrbyfloat", "SELECT s_suppkey AS key, round(s_acctbal - 0.25, 4) AS value FROM supplier")
def kv_incrbyfloat(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select(F_("s_suppkey").alias("key"), F_("s_acctbal").alias("value"))
    return kv.incr(t, t.select("key", F.lit(-0.25).alias("delta")), ["key"], kind="double").withColumn("value", F.round("value", 4))


@query("kv_append", "SELECT c_custkey AS key, c_name || '!' AS value FROM customer")
def kv_append(spark, sf_dir):
    return _strings(spark, sf_dir).select("key", kv.append(F_("value"), F.lit("!")).alias("value"))


@query("kv_strlen", "SELECT doc_id AS key, octet_length(encode(text)) AS n FROM documents")
def kv_strlen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F_("doc_id").alias("key"), F.octet_length("text").alias("n"))


@query("kv_setrange", "SELECT c_custkey AS key, substr(c_name, 1, 3) || 'XYZ' || substr(c_name, 7) AS value FROM customer")
def kv_setrange(spark, sf_dir):
    return _strings(spark, sf_dir).select("key", kv.setrange(F_("value"), 3, "XYZ").alias("value"))


# -- keys and expiry
@query("kv_exists", f"SELECT key FROM {_NEWS} WHERE key IN (SELECT c_custkey FROM customer)")
def kv_exists(spark, sf_dir):
    return kv.exists(_strings(spark, sf_dir), _news(spark, sf_dir))


@query("kv_type", "SELECT DISTINCT event_type AS key, 'set' AS type FROM events UNION ALL SELECT DISTINCT CAST(user_id AS VARCHAR), 'list' FROM events")
def kv_type(spark, sf_dir):
    lists = _lists(spark, sf_dir).withColumn("key", F_("key").cast("string"))
    return kv.types(set=_sets(spark, sf_dir), list=lists)


@query("kv_scan", "SELECT c_name AS key FROM customer WHERE c_name LIKE '%1' AND c_name > 'Customer#000000020' ORDER BY 1 LIMIT 7")
def kv_scan(spark, sf_dir):
    return kv.scan(table(spark, sf_dir, "customer").select(F_("c_name").alias("key")), after="Customer#000000020", pattern="*1", count=7)


@query("kv_rename", "SELECT CASE event_type WHEN 'click' THEN 'purchase' ELSE event_type END AS key, user_id AS member FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type <> 'purchase')")
def kv_rename(spark, sf_dir):
    return kv.rename(_sets(spark, sf_dir), "click", "purchase")


@query("kv_renamenx", "SELECT DISTINCT CASE event_type WHEN 'click' THEN 'fresh' ELSE event_type END AS key, user_id AS member FROM events")
def kv_renamenx(spark, sf_dir):
    return kv.renamenx(kv.renamenx(_sets(spark, sf_dir), "click", "purchase"), "click", "fresh")


@query("kv_copy", "SELECT DISTINCT event_type AS key, user_id AS member FROM events UNION ALL SELECT DISTINCT 'twin', user_id FROM events WHERE event_type = 'click'")
def kv_copy(spark, sf_dir):
    return kv.copy(_sets(spark, sf_dir), "click", "twin")


@query("kv_dbsize", "SELECT (SELECT count(DISTINCT event_type) FROM events) + (SELECT count(*) FROM customer) AS n_keys")
def kv_dbsize(spark, sf_dir):
    return kv.dbsize(_sets(spark, sf_dir), _strings(spark, sf_dir).withColumn("key", F_("key").cast("string")))


@query("kv_randomkey")
def kv_randomkey(spark, sf_dir):
    return _strings(spark, sf_dir).select("key").orderBy(F.rand()).limit(1)


@query("kv_expire", "SELECT c_custkey AS key, CASE WHEN c_custkey <= 10 THEN 30 WHEN c_custkey % 4 = 0 THEN -1 ELSE (c_custkey - 50) * 10 END AS ttl FROM customer")
def kv_expire(spark, sf_dir):
    t = _strings(spark, sf_dir)
    return kv.ttl(kv.expire(t, F_("key") <= 10, _at(F.lit(30))), _now(), t)


@query("kv_persist", "SELECT c_custkey AS key, CASE WHEN c_custkey <= 10 OR c_custkey % 4 = 0 THEN -1 ELSE (c_custkey - 50) * 10 END AS ttl FROM customer")
def kv_persist(spark, sf_dir):
    t = _strings(spark, sf_dir)
    return kv.ttl(kv.persist(t, F_("key") <= 10), _now(), t)


# -- fields
@query("kv_hset", f"SELECT key, field, CAST(CASE field WHEN 'click' THEN 7 ELSE value END AS BIGINT) AS value FROM {_HASH}")
def kv_hset(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return kv.put(h, h.where("field = 'click'").withColumn("value", F.lit(7).cast("long")), ["key", "field"])


@query("kv_hsetnx", f"SELECT key, field, CAST(value AS BIGINT) AS value FROM {_HASH} UNION ALL SELECT DISTINCT user_id, 'extra', 1 FROM events")
def kv_hsetnx(spark, sf_dir):
    h = _hash(spark, sf_dir)
    rows = h.select("key").distinct().select("key", F.explode(F.array(F.lit("extra"))).alias("field"), F.lit(1).cast("long").alias("value"))
    return kv.put(h, rows.unionByName(h.withColumn("value", F.lit(-1).cast("long"))), ["key", "field"], "nx")


@query("kv_hmget", f"SELECT w.key, w.field, h.value FROM (SELECT DISTINCT user_id AS key, 'click' AS field FROM events) w LEFT JOIN {_HASH} ON w.key = h.key AND w.field = h.field")
def kv_hmget(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return kv.mget(h, h.select("key").distinct().withColumn("field", F.lit("click")), ["key", "field"])


@query("kv_hdel", f"SELECT key, field, value FROM {_HASH} WHERE field <> 'click'")
def kv_hdel(spark, sf_dir):
    h = _hash(spark, sf_dir)
    return h.join(h.where("field = 'click'").select("key", "field"), ["key", "field"], "left_anti")


@query("kv_hkeys", f"SELECT key, field FROM {_HASH}")
def kv_hkeys(spark, sf_dir):
    return _hash(spark, sf_dir).select("key", "field")


@query("kv_hvals", f"SELECT key, value FROM {_HASH}")
def kv_hvals(spark, sf_dir):
    return _kv(_hash(spark, sf_dir))


@query("kv_hexpire", f"SELECT key, field FROM {_HASH} WHERE value > 1")
def kv_hexpire(spark, sf_dir):
    h = _hash(spark, sf_dir).withColumn("field_expire_at", F.when(F_("value") <= 1, _at(F.lit(-1))).otherwise(_at(F.lit(5))))
    return kv.live(h, _now(), "field_expire_at").select("key", "field")


# -- lists
@query("kv_lpush", f"SELECT key, pos, value FROM {_LISTS} UNION ALL SELECT user_id, min(event_id) - 1, 'front' FROM events GROUP BY user_id")
def kv_lpush(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return kv.push(lists, lists.select("key").distinct().select("key", F.lit(1).alias("ord"), F.lit("front").alias("value")), left=True)


@query("kv_lpop", f"SELECT key, pos, value FROM {_LISTS} WHERE i >= 2")
def kv_lpop(spark, sf_dir):
    return kv.pop(_lists(spark, sf_dir), 2)[1]


@query("kv_llen", "SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id")
def kv_llen(spark, sf_dir):
    return _lists(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


@query("kv_ltrim", f"SELECT key, pos, value FROM {_LISTS} WHERE i BETWEEN n - 3 AND n - 1")
def kv_ltrim(spark, sf_dir):
    return kv.lrange(_lists(spark, sf_dir), -3, -1)


# -- sets and sorted sets
@query("kv_sadd", "SELECT DISTINCT event_type AS key, user_id AS member FROM events UNION SELECT 'click', n_nationkey FROM nation")
def kv_sadd(spark, sf_dir):
    return kv.sadd(_sets(spark, sf_dir), table(spark, sf_dir, "nation").select(F.lit("click").alias("key"), F_("n_nationkey").cast("long").alias("member")))


@query("kv_srem", "SELECT DISTINCT event_type AS key, user_id AS member FROM events WHERE NOT (event_type = 'click' AND user_id IN (SELECT n_nationkey FROM nation))")
def kv_srem(spark, sf_dir):
    return kv.srem(_sets(spark, sf_dir), table(spark, sf_dir, "nation").select(F.lit("click").alias("key"), F_("n_nationkey").cast("long").alias("member")))


@query("kv_smembers", _TYPES.format("click"))
def kv_smembers(spark, sf_dir):
    return _sets(spark, sf_dir).where("key = 'click'").select("member")


@query("kv_smismember", f"SELECT 'click' AS key, CAST(n_nationkey AS BIGINT) AS member, CASE WHEN n_nationkey IN ({_TYPES.format('click')}) THEN 1 ELSE 0 END AS is_member FROM nation")
def kv_smismember(spark, sf_dir):
    return kv.smismember(_sets(spark, sf_dir), table(spark, sf_dir, "nation").select(F.lit("click").alias("key"), F_("n_nationkey").cast("long").alias("member")))


@query("kv_srandmember")
def kv_srandmember(spark, sf_dir):
    return kv.srandmember(_sets(spark, sf_dir), 2, seed=1)


@query("kv_zrevrank", f"SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM {_ZSET}")
def kv_zrevrank(spark, sf_dir):
    return kv.zrank(_zset(spark, sf_dir), rev=True)


@query("kv_zcard", f"SELECT key, count(*) AS n FROM {_ZSET} GROUP BY key")
def kv_zcard(spark, sf_dir):
    return _zset(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


@query("kv_zmscore", f"SELECT w.key, w.member, z.score FROM (SELECT DISTINCT user_id AS key, 'click' AS member FROM events) w LEFT JOIN {_ZSET} ON w.key = z.key AND w.member = z.member")
def kv_zmscore(spark, sf_dir):
    z = _zset(spark, sf_dir)
    return kv.mget(z, z.select("key").distinct().withColumn("member", F.lit("click")), ["key", "member"], "score")


@query("kv_zrem", f"SELECT key, member, score FROM {_ZSET} WHERE member <> 'click'")
def kv_zrem(spark, sf_dir):
    z = _zset(spark, sf_dir)
    return kv.srem(z, z.where("member = 'click'")).select("key", "member", "score")


@query("kv_zpopmax", f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS r FROM {_ZSET}) WHERE r > 1")
def kv_zpopmax(spark, sf_dir):
    return kv.zpop(_zset(spark, sf_dir), largest=True)[1]


@query("kv_zadd_nx", f"SELECT key, member, score FROM {_ZSET} UNION ALL SELECT DISTINCT user_id, 'extra', 20.0 FROM events")
def kv_zadd_nx(spark, sf_dir):
    z = _zset(spark, sf_dir)
    rows = z.withColumn("score", F.lit(20.0))
    return kv.zadd(z, rows.unionByName(rows.withColumn("member", F.lit("extra")).distinct()), "nx")


@query("kv_zadd_xx", f"SELECT key, member, CASE member WHEN 'click' THEN 20 ELSE score END AS score FROM {_ZSET}")
def kv_zadd_xx(spark, sf_dir):
    z = _zset(spark, sf_dir)
    rows = z.where("member = 'click'").withColumn("score", F.lit(20.0))
    return kv.zadd(z, rows.unionByName(rows.withColumn("member", F.lit("extra"))), "xx")


@query("kv_zadd_lt", f"SELECT key, member, least(score, 20) AS score FROM {_ZSET}")
def kv_zadd_lt(spark, sf_dir):
    z = _zset(spark, sf_dir)
    return kv.zadd(z, z.withColumn("score", F.lit(20.0)), "lt")


# -- streams
@query("kv_xrange", f"SELECT key, ms, seq, fields FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM {_STREAM} WHERE ms >= 28000000) WHERE r <= 5")
def kv_xrange(spark, sf_dir):
    return kv.xrange(_stream(spark, sf_dir), (28_000_000, 0), (2**62, 0), 5)


@query("kv_xread", f"SELECT key, ms, seq, fields FROM {_STREAM} WHERE ms > 28400000 OR (ms = 28400000 AND seq > 0)")
def kv_xread(spark, sf_dir):
    return kv.xread(_stream(spark, sf_dir), (28_400_000, 0))


@query("kv_xlen", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def kv_xlen(spark, sf_dir):
    return _stream(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


def _pending(spark, sf_dir):
    s = _stream(spark, sf_dir)
    return s.select("key", F.lit("g").alias("grp"), "ms", "seq", F.lit("c1").alias("consumer"), (F_("fields") * 10).alias("delivered_at"), F.lit(1).alias("deliveries"), "fields")


@query("kv_xclaim", f"SELECT fields AS entry, CASE WHEN 5000 - fields * 10 >= 1000 THEN 'c2' ELSE 'c1' END AS consumer, CASE WHEN 5000 - fields * 10 >= 1000 THEN 2 ELSE 1 END AS deliveries FROM {_STREAM}")
def kv_xclaim(spark, sf_dir):
    return kv.xclaim(_pending(spark, sf_dir), "c2", 1000, F.lit(5000).cast("long")).select(F_("fields").alias("entry"), "consumer", "deliveries")


@query("kv_xautoclaim", f"SELECT fields AS entry, CASE WHEN due AND r <= 3 THEN 'c2' ELSE 'c1' END AS consumer FROM (SELECT *, 5000 - fields * 10 >= 1000 AS due, row_number() OVER (PARTITION BY key, 5000 - fields * 10 >= 1000 ORDER BY ms, seq) AS r FROM {_STREAM})")
def kv_xautoclaim(spark, sf_dir):
    return kv.xautoclaim(_pending(spark, sf_dir), "c2", 1000, F.lit(5000).cast("long"), (0, 0), 3).select(F_("fields").alias("entry"), "consumer")


# -- sketches, bits, geo
@query("kv_pfmerge")
def kv_pfmerge(spark, sf_dir):
    return kv.pfcount(kv.pfmerge(kv.pfadd(_events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("value"))), "all"))


def _bits(spark, sf_dir):
    return _events(spark, sf_dir).select(F_("event_type").alias("key"), F_("user_id").alias("bit")).distinct()


@query("kv_setbit", "SELECT DISTINCT event_type AS key, user_id AS bit FROM events WHERE user_id >= 8 UNION ALL SELECT DISTINCT event_type, 3 FROM events")
def kv_setbit(spark, sf_dir):
    t = _bits(spark, sf_dir)
    rows = t.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("bit"))
    return kv.setbit(t, rows.withColumn("value", (F_("bit") == 3).cast("int")))


@query("kv_getbit", f"SELECT 'click' AS key, CAST(n_nationkey AS BIGINT) AS bit, CASE WHEN n_nationkey IN ({_TYPES.format('click')}) THEN 1 ELSE 0 END AS value FROM nation")
def kv_getbit(spark, sf_dir):
    return kv.getbit(_bits(spark, sf_dir), table(spark, sf_dir, "nation").select(F.lit("click").alias("key"), F_("n_nationkey").cast("long").alias("bit")))


@query("kv_bitop_not", f"SELECT CAST(r AS BIGINT) AS bit FROM range(0, (SELECT max(member) // 8 * 8 + 8 FROM ({_TYPES.format('click')}))) t(r) WHERE r NOT IN ({_TYPES.format('click')})")
def kv_bitop_not(spark, sf_dir):
    return kv.bitnot(_bits(spark, sf_dir), "click")


@query("kv_bitop_xor", f"({_TYPES.format('click')} EXCEPT {_TYPES.format('purchase')}) UNION ({_TYPES.format('purchase')} EXCEPT {_TYPES.format('click')})".replace("AS member", "AS bit"))
def kv_bitop_xor(spark, sf_dir):
    return kv.bitop("xor", _bits(spark, sf_dir), "click", "purchase")


@query("kv_geoadd", "SELECT c_custkey AS member, CAST(CASE WHEN c_custkey % 5 = 0 THEN 12 ELSE (c_custkey * 37) % 360 - 180 END AS DOUBLE) AS lon FROM customer")
def kv_geoadd(spark, sf_dir):
    t = _geo(spark, sf_dir)
    rows = t.withColumn("lon", F.lit(12.0)).withColumn("lat", F.when(F_("member") % 5 == 0, 45.0).otherwise(89.0))
    return kv.geoadd(t, rows).select("member", "lon")
