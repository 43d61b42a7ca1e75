"""Key-value structures as long tables: every command is a transform of, or a query over, a DataFrame.

Strings are (key, value, expire_at), hashes (key, field, value, field_expire_at), lists (key, pos, value), sets
(key, member), sorted sets (key, member, score), streams (key, ms, seq, fields), pending entries (key, grp, ms, seq,
consumer, delivered_at, deliveries), bitmaps (key, bit) and geo sets (key, member, lon, lat). Expiry is a column that
is filtered when a table is read. Commands work on all keys of a table at once or on those in ``keys``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.spatial import GEO_LATITUDE, GEO_SPHERE, GEO_UNITS, haversine


# -- any table --------------------------------------------------------------------------------------------------
def live(t: DataFrame, now: Column, expiry: str = "expire_at") -> DataFrame:
    return t.where(F.col(expiry).isNull() | (F.col(expiry) > now))


def glob(pattern: str) -> str:
    """A KEYS pattern as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[i:]:
            end = pattern.index("]", i)
            out += "[" + pattern[i + 1 : end] + "]"
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\Q" + pattern[i] + "\\E"
        else:
            out += "\\Q" + ch + "\\E"
        i += 1
    return f"(?s)^{out}$"


def keys(t: DataFrame, pattern: str) -> DataFrame:
    return t.select("key").distinct().where(F.col("key").rlike(glob(pattern)))


def scan(t: DataFrame, after: str | None, count: int, pattern: str = "*") -> DataFrame:
    """SCAN: the next keys in order behind a cursor key."""
    found = keys(t, pattern)
    return (found.where(F.col("key") > after) if after is not None else found).orderBy("key").limit(count)


def exists(t: DataFrame, wanted: DataFrame) -> DataFrame:
    return t.select("key").distinct().join(wanted.select("key").distinct(), "key", "left_semi")


def delete(t: DataFrame, gone: DataFrame) -> DataFrame:
    return t.join(gone.select("key").distinct(), "key", "left_anti")


def dbsize(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("key")
    for t in tables[1:]:
        out = out.union(t.select("key"))
    return out.agg(F.countDistinct("key").alias("n_keys"))


def types(**tables: DataFrame) -> DataFrame:
    """TYPE: (key, type) over the tables of a database."""
    parts = [t.select("key", F.lit(kind).alias("type")).distinct() for kind, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def rename(t: DataFrame, old: str, new: str) -> DataFrame:
    """RENAME: what the new key held goes."""
    moved = t.where(F.col("key") == old).withColumn("key", F.lit(new))
    return t.where(~F.col("key").isin(old, new)).unionByName(moved)


def renamenx(t: DataFrame, old: str, new: str) -> DataFrame:
    """RENAMENX: nothing changes if the new key is there."""
    taken = t.where(F.col("key") == new).select(F.lit(True).alias("_taken")).limit(1)
    marked = t.join(taken, F.lit(True), "left")
    return marked.withColumn("key", F.when((F.col("key") == old) & F.col("_taken").isNull(), new).otherwise(F.col("key"))).select(*t.columns)


def copy(t: DataFrame, source: str, target: str) -> DataFrame:
    return t.where(F.col("key") != target).unionByName(t.where(F.col("key") == source).withColumn("key", F.lit(target)))


def expire(t: DataFrame, wanted: Column, at: Column) -> DataFrame:
    return t.withColumn("expire_at", F.when(wanted, at).otherwise(F.col("expire_at")))


def persist(t: DataFrame, wanted: Column) -> DataFrame:
    return expire(t, wanted, F.lit(None))


def ttl(t: DataFrame, now: Column, wanted: DataFrame) -> DataFrame:
    """Seconds to live: -1 without expiry, -2 for a key that is not there."""
    left = wanted.select("key").distinct().join(t.select("key", "expire_at", F.lit(True).alias("there")).distinct(), "key", "left")
    seconds = F.when(F.col("there").isNull(), -2).when(F.col("expire_at").isNull(), -1).otherwise(F.ceil(F.unix_micros(F.col("expire_at").cast("timestamp")) / 1e6 - F.unix_micros(now.cast("timestamp")) / 1e6))
    return left.select("key", seconds.cast("long").alias("ttl"))


def select(t: DataFrame, index: int, db: str = "db") -> DataFrame:
    """SELECT: the keys of one of the databases that a table holds."""
    return t.where(F.col(db) == index).drop(db)


def flushdb(t: DataFrame, index: int, db: str = "db") -> DataFrame:
    return t.where(F.col(db) != index)


def flushall(t: DataFrame) -> DataFrame:
    return t.limit(0)


def time() -> Column:
    """TIME: (seconds, microseconds) of the query's start."""
    micros = F.unix_micros(F.current_timestamp())
    return F.struct(F.floor(micros / 1_000_000).alias("seconds"), F.pmod(micros, F.lit(1_000_000)).alias("micros"))


# -- strings and hashes -----------------------------------------------------------------------------------------
def put(t: DataFrame, rows: DataFrame, ids: list[str], only: str | None = None, order: Column | None = None) -> DataFrame:
    """SET, MSET, HSET, HMSET: rows take the place of those with their ids. ``nx`` only adds, ``xx`` only changes. Of several
    rows of the same ids the last by order counts, with ``nx`` the first; without an order the greatest and the least row."""
    held = F.struct(*[F.col(c) for c in rows.columns])
    pick = F.min_by if only == "nx" else F.max_by
    rows = rows.groupBy(*[F.col(c).alias(f"_id_{c}") for c in ids]).agg(pick(held, order if order is not None else held).alias("_row")).select("_row.*")
    if only == "nx":
        return t.unionByName(rows.join(t.select(*ids), ids, "left_anti").select(*t.columns))
    if only == "xx":
        rows = rows.join(t.select(*ids), ids, "left_semi")
    return t.join(rows.select(*ids), ids, "left_anti").select(*t.columns).unionByName(rows.select(*t.columns))


def mget(t: DataFrame, wanted: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """MGET, HMGET: null for what is not there."""
    return wanted.join(t.select(*ids, value), ids, "left")


def set_if(t: DataFrame, rows: DataFrame, ids: list[str], equal: bool = True) -> DataFrame:
    """SET with IFEQ or IFNE: rows: (*ids, value, expected). Only rows that are there are compared."""
    new = rows.select(*ids, F.col("value").alias("_new"), F.col("expected").alias("_expected"))
    same = F.col("value") == F.col("_expected")
    return t.join(new, ids, "left").withColumn("value", F.when(same if equal else ~same, F.col("_new")).otherwise(F.col("value"))).select(*t.columns)


def incr(t: DataFrame, deltas: DataFrame, ids: list[str], value: str = "value", kind: str = "long") -> DataFrame:
    """INCRBY, INCRBYFLOAT, HINCRBY: base rows and deltas are summed; a missing one starts at 0."""
    rows = t.select(*ids, F.col(value).cast(kind).alias(value)).unionByName(deltas.select(*ids, F.col("delta").cast(kind).alias(value)))
    return rows.groupBy(*ids).agg(F.sum(value).alias(value))


def getset(t: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETSET, SET with GET: (the table afterwards, without expiry for what was set; the old value of each key, null if none)."""
    old = mget(t, rows.select("key").distinct(), ["key"])
    return put(t, rows.withColumn("expire_at", F.lit(None).cast(t.schema["expire_at"].dataType)), ["key"]), old


def set_keepttl(t: DataFrame, rows: DataFrame) -> DataFrame:
    """SET with KEEPTTL: the expiry of a key that is there stays."""
    old = t.select("key", F.col("expire_at").alias("_old"))
    kept = rows.drop("expire_at").join(old, "key", "left").withColumnRenamed("_old", "expire_at")
    return put(t, kept.select(*t.columns), ["key"])


def pttl(t: DataFrame, now: Column, wanted: DataFrame, ids: list[str], expiry: str = "expire_at") -> DataFrame:
    """PTTL, HPTTL: milliseconds to live: -1 without expiry, -2 for what is not there."""
    left = wanted.select(*ids).distinct().join(t.select(*ids, F.col(expiry).alias("_at"), F.lit(True).alias("there")), ids, "left")
    millis = F.unix_micros(F.col("_at").cast("timestamp")) / 1000 - F.unix_micros(now.cast("timestamp")) / 1000
    return left.select(*ids, F.when(F.col("there").isNull(), -2).when(F.col("_at").isNull(), -1).otherwise(F.ceil(millis)).cast("long").alias("pttl"))


def expiretime(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """EXPIRETIME: seconds of the epoch: -1 without expiry, -2 for a key that is not there."""
    left = wanted.select("key").distinct().join(t.select("key", "expire_at", F.lit(True).alias("there")), "key", "left")
    return left.select("key", F.when(F.col("there").isNull(), -2).when(F.col("expire_at").isNull(), -1).otherwise(F.floor(F.unix_micros(F.col("expire_at").cast("timestamp")) / 1000000)).cast("long").alias("at"))


def hpexpire(t: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """HPEXPIRE, HEXPIRE: wanted: (key, field). (the table afterwards, 1 for each field that is there, -2 for others)."""
    rows = wanted.select("key", "field").distinct()
    hit = t.join(rows.withColumn("_hit", F.lit(True)), ["key", "field"], "left")
    after = hit.withColumn("field_expire_at", F.when(F.col("_hit"), at).otherwise(F.col("field_expire_at"))).select(*t.columns)
    there = t.select("key", "field", F.lit(1).alias("_there")).distinct()
    return after, rows.join(there, ["key", "field"], "left").select("key", "field", F.coalesce("_there", F.lit(-2)).alias("done"))


def hexists(t: DataFrame, wanted: DataFrame) -> DataFrame:
    there = t.select("key", "field", F.lit(1).alias("there")).distinct()
    return wanted.join(there, ["key", "field"], "left").select("key", "field", F.coalesce("there", F.lit(0)).alias("there"))


def spop(t: DataFrame, count: int, seed: str = "spop") -> tuple[DataFrame, DataFrame]:
    """SPOP: (members that stay, members taken): count members of each key in the order of a digest, so reruns agree."""
    order = F.md5(F.concat_ws(":", "member", F.lit(seed)))
    ranked = t.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(order, "member")))
    return ranked.where(F.col("_r") > count).drop("_r"), ranked.where(F.col("_r") <= count).drop("_r")


def append(value: Column, tail: Column) -> Column:
    return F.concat(F.coalesce(value, F.lit("")), tail)


def getrange(value: Column, start: int, stop: int) -> Column:
    """0-based, inclusive, negative from the end."""
    n = F.char_length(value)
    a = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(a > b, "").otherwise(F.substring(value, a + 1, b - a + 1))


def setrange(value: Column, offset: int, new: str) -> Column:
    """Padded with zero characters up to offset."""
    return F.overlay(F.rpad(value, F.greatest(F.char_length(value), F.lit(offset)), F.lit("\0")), F.lit(new), F.lit(offset + 1))


def hgetall(t: DataFrame) -> DataFrame:
    return t.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


# -- lists ------------------------------------------------------------------------------------------------------
def _placed(t: DataFrame) -> DataFrame:
    return t.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("pos")) - 1).withColumn("n", F.count("*").over(W.partitionBy("key")))


def push(t: DataFrame, rows: DataFrame, left: bool = False) -> DataFrame:
    """rows: (key, ord, value). Positions go on from the end, or down from the front, in order of ord."""
    ends = t.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    n = F.row_number().over(W.partitionBy("key").orderBy("ord"))
    rows = rows.join(ends, "key", "left").withColumn("n", n)
    pos = F.coalesce("lo", F.lit(0)) - F.col("n") if left else F.coalesce("hi", F.lit(-1)) + F.col("n")
    return t.unionByName(rows.select("key", pos.cast("long").alias("pos"), "value"))


def lrange(t: DataFrame, start: int, stop: int) -> DataFrame:
    """Inclusive, negative from the end; also LTRIM."""
    p = _placed(t)
    a = F.lit(start) if start >= 0 else F.col("n") + start
    b = F.lit(stop) if stop >= 0 else F.col("n") + stop
    return p.where(F.col("i").between(a, b)).drop("i", "n")


def lindex(t: DataFrame, i: int) -> DataFrame:
    return lrange(t, i, i)


def lset(t: DataFrame, i: int, value: Column) -> DataFrame:
    p = _placed(t)
    at = F.lit(i) if i >= 0 else F.col("n") + i
    return p.withColumn("value", F.when(F.col("i") == at, value).otherwise(F.col("value"))).drop("i", "n")


def pop(t: DataFrame, n: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """What is popped, and what stays."""
    p = _placed(t)
    out = F.col("i") < n if left else F.col("i") >= F.col("n") - n
    return p.where(out).drop("i", "n"), p.where(~out).drop("i", "n")


def lpos(t: DataFrame, value: str, rank: int = 1, count: int = 1) -> DataFrame:
    """Places of a value, from the rank-th match on, backwards for a negative rank; all for count 0."""
    hit = _placed(t).where(F.col("value") == value)
    order = F.col("i").asc() if rank > 0 else F.col("i").desc()
    hit = hit.withColumn("m", F.row_number().over(W.partitionBy("key").orderBy(order)))
    first = abs(rank)
    return hit.where((F.col("m") >= first) & (F.lit(count == 0) | (F.col("m") < first + count))).select("key", F.col("i").cast("long").alias("place"))


# -- sets -------------------------------------------------------------------------------------------------------
def sadd(t: DataFrame, rows: DataFrame) -> DataFrame:
    return t.select("key", "member").union(rows.select("key", "member")).distinct()


def srem(t: DataFrame, rows: DataFrame) -> DataFrame:
    return t.join(rows.select("key", "member"), ["key", "member"], "left_anti")


def sunion(t: DataFrame, *names: str) -> DataFrame:
    return t.where(F.col("key").isin(*names)).select("member").distinct()


def sinter(t: DataFrame, *names: str) -> DataFrame:
    return t.where(F.col("key").isin(*names)).groupBy("member").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(set(names))).select("member")


def sdiff(t: DataFrame, first: str, *others: str) -> DataFrame:
    return t.where(F.col("key") == first).select("member").distinct().join(t.where(F.col("key").isin(*others)).select("member"), "member", "left_anti")


def smismember(t: DataFrame, wanted: DataFrame) -> DataFrame:
    there = t.select("key", "member").distinct().withColumn("there", F.lit(1))
    return wanted.join(there, ["key", "member"], "left").select("key", "member", F.coalesce("there", F.lit(0)).alias("is_member"))


def srandmember(t: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random members of each key; SPOP takes them out with ``srem``."""
    return t.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.rand(seed)))).where(F.col("r") <= n).drop("r")


# -- sorted sets: by score, then member -------------------------------------------------------------------------
def _ranked(t: DataFrame, rev: bool = False) -> DataFrame:
    order = [F.col("score").desc(), F.col("member").desc()] if rev else ["score", "member"]
    return t.withColumn("rank", (F.row_number().over(W.partitionBy("key").orderBy(*order)) - 1).cast("long"))


def zadd(t: DataFrame, rows: DataFrame, mode: str | None = None) -> DataFrame:
    """mode: nx only adds, xx only changes, gt and lt only raise or lower the score of a member that is there."""
    new = rows.select("key", "member", F.col("score").alias("s"))
    both = t.join(new, ["key", "member"], "full_outer")
    there, comes = F.col("score").isNotNull(), F.col("s").isNotNull()
    changed = {"nx": F.col("score"), "gt": F.greatest("score", "s"), "lt": F.least("score", "s")}.get(mode, F.col("s"))
    out = both.withColumn("score", F.when(there & comes, changed).when(there, F.col("score")).otherwise(F.lit(None) if mode == "xx" else F.col("s")))
    return out.where("score is not null").select("key", "member", "score")


def zincrby(t: DataFrame, rows: DataFrame) -> DataFrame:
    return incr(t, rows, ["key", "member"], "score", "double")


def zrank(t: DataFrame, rev: bool = False) -> DataFrame:
    return _ranked(t, rev).select("key", "member", "rank")


def zrange(t: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    p = _ranked(t, rev).withColumn("n", F.count("*").over(W.partitionBy("key")))
    a = F.lit(start) if start >= 0 else F.col("n") + start
    b = F.lit(stop) if stop >= 0 else F.col("n") + stop
    return p.where(F.col("rank").between(a, b)).drop("n")


def score_range(low: str, high: str) -> Column:
    """Bounds as the commands write them: "(1.5" leaves 1.5 out, "-inf" and "+inf" are open."""

    def bound(text: str, less: bool) -> Column:
        out = text.startswith("(")
        x = float(text.lstrip("("))
        s = F.col("score")
        return (s > x if out else s >= x) if less else (s < x if out else s <= x)

    return bound(low, True) & bound(high, False)


def zrangebyscore(t: DataFrame, low: str, high: str, offset: int = 0, count: int | None = None) -> DataFrame:
    found = _ranked(t.where(score_range(low, high)))
    if count is not None:
        found = found.where(F.col("rank").between(offset, offset + count - 1))
    return found.select("key", "member", "score")


def zcount(t: DataFrame, low: str, high: str) -> DataFrame:
    return t.groupBy("key").agg(F.count_if(score_range(low, high)).alias("n"))


def zpop(t: DataFrame, n: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    p = _ranked(t, largest)
    return p.where(F.col("rank") < n).drop("rank"), p.where(F.col("rank") >= n).drop("rank")


# -- streams ----------------------------------------------------------------------------------------------------
def xadd(rows: DataFrame) -> DataFrame:
    """rows: (key, ms, ord, fields). Entries of one millisecond are numbered in order."""
    seq = (F.row_number().over(W.partitionBy("key", "ms").orderBy("ord")) - 1).cast("long")
    return rows.select("key", "ms", seq.alias("seq"), "fields")


def _entry() -> Column:
    return F.struct("ms", "seq")


def xrange(t: DataFrame, first: tuple[int, int], last: tuple[int, int], count: int | None = None) -> DataFrame:
    at = lambda e: F.struct(F.lit(e[0]).cast("long").alias("ms"), F.lit(e[1]).cast("long").alias("seq"))
    found = t.where((_entry() >= at(first)) & (_entry() <= at(last)))
    if count is not None:
        found = found.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("ms", "seq"))).where(F.col("r") <= count).drop("r")
    return found


def xread(t: DataFrame, after: tuple[int, int], count: int | None = None) -> DataFrame:
    """Entries behind an id."""
    return xrange(t, (after[0], after[1] + 1), (2**63 - 1, 2**63 - 1), count)


def xtrim(t: DataFrame, most: int) -> DataFrame:
    """The newest entries of each key."""
    order = W.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc())
    return t.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def xinfo(t: DataFrame) -> DataFrame:
    ident = lambda e: F.concat_ws("-", e["ms"], e["seq"])
    return t.groupBy("key").agg(F.count("*").alias("length"), F.min(_entry()).alias("a"), F.max(_entry()).alias("b")).select("key", "length", ident(F.col("a")).alias("first_id"), ident(F.col("b")).alias("last_id"))


def xpending(delivered: DataFrame, acked: DataFrame) -> DataFrame:
    """Entries that a group was given and has not acknowledged."""
    return delivered.join(acked, ["key", "grp", "ms", "seq"], "left_anti")


def xpending_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("first"), F.max(F.struct("ms", "seq")).alias("last")).select("key", "grp", "consumer", "n", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"))


def _last_of(t: DataFrame) -> DataFrame:
    return t.groupBy("key").agg(F.max(_entry()).alias("_top")).select("key", F.col("_top.ms").alias("_ms"), F.col("_top.seq").alias("_seq"))


def xgroup_create(groups: DataFrame, t: DataFrame, grp: str, after: tuple[int, int] | None = None) -> DataFrame:
    """groups: (key, grp, last_ms, last_seq). XGROUP CREATE for each key of a stream, from an id on or, without one, from the
    newest entry; a group that is there stays as it is."""
    at = lambda i, own: F.col(own) if after is None else F.lit(after[i]).cast("long")
    new = _last_of(t).select("key", F.lit(grp).alias("grp"), at(0, "_ms").alias("last_ms"), at(1, "_seq").alias("last_seq"))
    return groups.unionByName(new.join(groups.select("key", "grp"), ["key", "grp"], "left_anti"))


def xgroup_setid(groups: DataFrame, t: DataFrame, grp: str, after: tuple[int, int] | None = None) -> DataFrame:
    """XGROUP SETID of a group of each key; groups of streams that are not there stay."""
    rows = groups.join(_last_of(t), "key", "left")
    hit = (F.col("grp") == grp) & F.col("_ms").isNotNull()
    at = lambda i, own: F.col(own) if after is None else F.lit(after[i]).cast("long")
    return rows.select("key", "grp", F.when(hit, at(0, "_ms")).otherwise(F.col("last_ms")).alias("last_ms"), F.when(hit, at(1, "_seq")).otherwise(F.col("last_seq")).alias("last_seq"))


def xgroup_destroy(groups: DataFrame, grp: str) -> DataFrame:
    return groups.where(F.col("grp") != grp)


def xreadgroup(t: DataFrame, groups: DataFrame, grp: str, consumer: str, count: int, now_ms: Column) -> tuple[DataFrame, DataFrame]:
    """XREADGROUP with ">": (the entries given as pending ones, the groups afterwards): the next ``count`` of each key."""
    own = groups.where(F.col("grp") == grp).select("key", F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq")).alias("_after"))
    new = t.join(own, "key").where(_entry() > F.col("_after")).withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("ms", "seq"))).where(F.col("_r") <= count)
    given = new.select("key", F.lit(grp).alias("grp"), "ms", "seq", F.lit(consumer).alias("consumer"), now_ms.cast("long").alias("delivered_at"), F.lit(1).alias("deliveries"))
    rows = groups.join(_last_of(given), "key", "left")
    hit = (F.col("grp") == grp) & F.col("_ms").isNotNull()
    return given, rows.select("key", "grp", F.when(hit, F.col("_ms")).otherwise(F.col("last_ms")).alias("last_ms"), F.when(hit, F.col("_seq")).otherwise(F.col("last_seq")).alias("last_seq"))


def xack(pending: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids: (key, grp, ms, seq). (what is pending still, (key, grp, n) of the entries acknowledged)."""
    by = ["key", "grp", "ms", "seq"]
    done = pending.join(ids.select(*by), by, "left_semi").groupBy("key", "grp").agg(F.count("*").alias("n"))
    return xpending(pending, ids.select(*by)), done


def xsetid(last: DataFrame, ids: DataFrame) -> DataFrame:
    """last: (key, ms, seq), the newest id of each stream; ids: the same, one for a key. Of streams that are there it is set."""
    new = ids.select("key", F.col("ms").alias("_ms"), F.col("seq").alias("_seq"))
    return last.join(new, "key", "left").select("key", F.coalesce("_ms", "ms").alias("ms"), F.coalesce("_seq", "seq").alias("seq"))


def xclaim(pending: DataFrame, consumer: str, idle_ms: int, now_ms: Column) -> DataFrame:
    """Entries idle for so long change hands."""
    idle = now_ms - F.col("delivered_at") >= idle_ms
    return pending.withColumn("consumer", F.when(idle, consumer).otherwise(F.col("consumer"))).withColumn("deliveries", F.col("deliveries") + idle.cast("int")).withColumn("delivered_at", F.when(idle, now_ms).otherwise(F.col("delivered_at")))


def xautoclaim(pending: DataFrame, consumer: str, idle_ms: int, now_ms: Column, after: tuple[int, int], count: int) -> DataFrame:
    """XCLAIM of the first idle entries of each key and group from an id on."""
    at = F.struct(F.lit(after[0]).cast("long").alias("ms"), F.lit(after[1]).cast("long").alias("seq"))
    due = (_entry() >= at) & (now_ms - F.col("delivered_at") >= idle_ms)
    order = W.partitionBy("key", "grp", due).orderBy("ms", "seq")
    hit = due & (F.row_number().over(order) <= count)
    marked = pending.withColumn("_hit", hit)
    return marked.select(*[{"consumer": F.when(F.col("_hit"), consumer).otherwise(F.col("consumer")), "deliveries": F.col("deliveries") + F.col("_hit").cast("int"), "delivered_at": F.when(F.col("_hit"), now_ms).otherwise(F.col("delivered_at"))}.get(c, F.col(c)).alias(c) for c in pending.columns])


# -- sketches, bits, geo ----------------------------------------------------------------------------------------
def pfadd(t: DataFrame, value: str = "value") -> DataFrame:
    return t.groupBy("key").agg(F.hll_sketch_agg(F.col(value), F.lit(14)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def pfmerge(sketches: DataFrame, target: str) -> DataFrame:
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(target).alias("key"), "sketch")


def setbit(t: DataFrame, rows: DataFrame) -> DataFrame:
    """t: (key, bit) of the bits that are 1; rows: (key, bit, value)."""
    return t.join(rows.select("key", "bit"), ["key", "bit"], "left_anti").unionByName(rows.where("value = 1").select("key", "bit"))


def bitcount(t: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Over bytes first to last."""
    there = t.where(F.col("bit") >= first * 8)
    there = there if last is None else there.where(F.col("bit") < (last + 1) * 8)
    return there.groupBy("key").agg(F.countDistinct("bit").alias("n"))


def bitop(op: str, t: DataFrame, *names: str) -> DataFrame:
    """(bit): and, or, xor of keys."""
    n = t.where(F.col("key").isin(*names)).distinct().groupBy("bit").agg(F.count("*").alias("n"))
    keep = {"and": F.col("n") == len(set(names)), "or": F.col("n") > 0, "xor": F.col("n") % 2 == 1}[op]
    return n.where(keep).select("bit")


def getbit(t: DataFrame, wanted: DataFrame) -> DataFrame:
    there = t.select("key", "bit").distinct().withColumn("there", F.lit(1))
    return wanted.join(there, ["key", "bit"], "left").select("key", "bit", F.coalesce("there", F.lit(0)).alias("value"))


def bitnot(t: DataFrame, name: str) -> DataFrame:
    """(bit): the bits of whole bytes that are 0 in a key."""
    ones = t.where(F.col("key") == name).select(F.col("bit").cast("long").alias("bit")).distinct()
    top = ones.agg(F.max("bit")).first()[0]  # one number
    every = t.sparkSession.range(0 if top is None else (top // 8 + 1) * 8).select(F.col("id").alias("bit"))
    return every.join(ones, "bit", "left_anti")


def geoadd(t: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows out of the range of Web Mercator are refused, the others take the place of those with their ids."""
    fit = rows.where(F.col("lon").between(-180, 180) & F.col("lat").between(-GEO_LATITUDE, GEO_LATITUDE))
    return put(t, fit, ["key", "member"])


def geopos(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, member, lon, lat): null for members that are not there."""
    return wanted.join(t.select("key", "member", "lon", "lat"), ["key", "member"], "left")


def geodist(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, unit: str = "m") -> Column:
    return haversine(a_lon, a_lat, b_lon, b_lat) / GEO_UNITS[unit]


def _in_box(lon: float, lat: float, angle: float) -> Column:
    """Whether a member lies in the box of degrees around a circle of so many radians; over a pole all longitudes do."""
    reach = math.degrees(angle)
    inside = F.col("lat").between(lat - reach, lat + reach)
    if abs(lat) + reach >= 90 or angle >= math.pi / 2:
        return inside
    wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + 1e-9
    away = F.abs(F.col("lon") - lon)
    return inside & (F.least(away, 360 - away) <= wide)


def geosearch_box(t: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    """BYBOX: members no further east or west than half the width, along their own parallel, and no further north or south
    than half the height."""
    east = haversine(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat")) / GEO_UNITS[unit]
    north = haversine(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat")) / GEO_UNITS[unit]
    near = t.where(F.col("lat").between(lat - math.degrees(height * GEO_UNITS[unit] / GEO_SPHERE), lat + math.degrees(height * GEO_UNITS[unit] / GEO_SPHERE)))
    near = near.where((east <= width / 2) & (north <= height / 2))
    return near.withColumn("dist", geodist(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat), unit))


def geosearch(t: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None) -> DataFrame:
    """Members within a radius, nearest first for each key. A box of degrees prunes rows before distances are taken."""
    angle = radius * GEO_UNITS[unit] / GEO_SPHERE
    found = t.where(_in_box(lon, lat, angle)).withColumn("dist", geodist(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat), unit)).where(F.col("dist") <= radius)
    if count is not None:
        found = found.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("dist", "member"))).where(F.col("r") <= count).drop("r")
    return found
