"""What the oracles do not see: repeated keys, routines that fail, plans, and functions that SQL has no yardstick for."""

import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur import catalog, kv
from larkspur.functions import spatial
from larkspur.operators import dml, fulltext, interval, partitions, ranking
from larkspur.operators.routines import RoutineError, Routines, Triggers, parse_procedure

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_repeated_keys_of_put(spark):
    t = spark.createDataFrame([("k", "a"), ("m", "z")], "key string, value string")
    new = spark.createDataFrame([("k", "b", 1), ("k", "c", 2), ("n", "x", 2), ("n", "y", 1)], "key string, value string, at int")
    by = F.col("at")
    assert rows(kv.put(t, new, ["key"], order=by)) == [("k", "c"), ("m", "z"), ("n", "x")]
    assert rows(kv.put(t, new, ["key"], "nx", by)) == [("k", "a"), ("m", "z"), ("n", "y")]
    assert rows(kv.put(t, new, ["key"], "xx", by)) == [("k", "c"), ("m", "z")]
    assert rows(kv.put(t, new.drop("at"), ["key"])) == rows(kv.put(t, new.drop("at").repartition(3), ["key"])) == [("k", "c"), ("m", "z"), ("n", "y")]


def test_repeated_keys_of_tables(spark):
    t = spark.createDataFrame([(1, 10)], "k int, v int")
    new = spark.createDataFrame([(1, 5, 2), (1, 9, 1), (2, 7, 1), (2, 3, 2)], "k int, v int, at int")
    by = F.col("at")
    assert rows(dml.insert_ignore(t, new, ["k"], by)) == [(1, 10), (2, 7)]
    assert rows(dml.insert_ignore(t, new.drop("at"), ["k"])) == [(1, 10), (2, 3)]
    assert rows(dml.replace(t, new, ["k"], by)) == [(1, 5), (2, 3)]
    assert rows(dml.replace(t, new.drop("at"), ["k"])) == [(1, 9), (2, 7)]
    assert rows(dml.upsert(t, new, ["k"], {"v": F.col("v") + F.col("new_v")}, by)) == [(1, 15), (2, 3)]


def test_ranks_of_nulls_and_single_values(spark):
    data = [(None, 1), (None, None), ("a", 3), ("a", 3), ("a", 5), ("b", 2)]
    got = rows(ranking.rank_by_value(spark.createDataFrame(data, "g string, v int"), "g", "v"))
    want = rows(spark.createDataFrame(data, "g string, v int").selectExpr("g", "v", *[f"{f}() over (partition by g order by v) as {f}" for f in ("rank", "dense_rank", "cume_dist", "percent_rank")]))
    assert got == want


def test_numbers_go_on(spark):
    data = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(9)
    assert [r.number for r in ranking.numbered(data, "v", start=5).orderBy("v").collect()] == list(range(5, 1005))


def test_band_and_asof_against_brute_force(spark):
    r = random.Random(4)
    a = [(i, r.choice("xy"), r.uniform(-20, 20)) for i in range(80)]
    left, right = (spark.createDataFrame(a, f"{n}id int, k string, {n} double") for n in "ab")
    for low, high in ((-1.5, 2.0), (0.0, 0.5), (3.0, 4.0)):
        got = rows(interval.band_join(left, right, ["k"], "a", "b", low, high).select("aid", "bid"))
        assert got == sorted(((i, j) for i, k, x in a for j, m, y in a if k == m and x + low <= y <= x + high), key=repr)
    events = [(i, r.choice("xyz"), r.randint(0, 30)) for i in range(60)]
    marks = [(k, t, f"{k}{t}") for k in "xy" for t in r.sample(range(30), 6)]
    got = rows(interval.asof_join(spark.createDataFrame(events, "i int, k string, t int"), spark.createDataFrame(marks, "k string, t int, m string"), ["k"], "t", ["m"]).select("i", "m"))
    assert got == sorted(((i, max(((u, m) for j, u, m in marks if j == k and u <= t), default=(0, None))[1]) for i, k, t in events), key=repr)


def test_routines_that_fail(spark):
    routines = Routines(spark)
    with pytest.raises(RoutineError):
        parse_procedure("SELECT 1")
    routines.create("CREATE PROCEDURE p(IN a INT) BEGIN SELECT a AS v; END")
    for act in (lambda: routines.create("CREATE PROCEDURE P() BEGIN SELECT 1; END"), lambda: routines.call("p"), lambda: routines.call("q"), lambda: routines.drop("q")):
        with pytest.raises(RoutineError):
            act()
    routines.create("CREATE OR REPLACE PROCEDURE p(IN a STRING) BEGIN SELECT concat(a, '!') AS v; END")
    assert rows(routines.call("P", "it's")) == [("it's!",)]
    routines.create("CREATE PROCEDURE s() BEGIN SIGNAL SQLSTATE '45000' SET MESSAGE_TEXT = 'no way'; END")
    with pytest.raises(Exception, match="no way"):
        routines.call("s").collect()
    triggers = Triggers()
    triggers.create("t", "before", "insert", lambda x: x)
    with pytest.raises(RoutineError):
        triggers.create("t", "after", "insert", lambda x: x)
    triggers.drop("t")
    with pytest.raises(RoutineError):
        triggers.create("u", "during", "insert", lambda x: x)


def test_functions_without_sql(spark):
    def soundex(word):
        codes = {c: d for d, cs in {"1": "bfpv", "2": "cgjkqsxz", "3": "dt", "4": "l", "5": "mn", "6": "r"}.items() for c in cs}
        out, before = word[0].upper(), codes.get(word[0].lower(), "")
        for ch in word[1:].lower():
            d = codes.get(ch, "")
            if d and d != before:
                out += d
            if ch not in "hw":
                before = d
        return out

    q = catalog.queries()
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in q["fn_crc32"](spark, SF).collect():
        assert r.v == zlib.crc32(names[r.k].encode())
    assert q["fn_database"](spark, SF).first().v == spark.catalog.currentDatabase()
    found = {names[r.k].split()[0]: r.v for r in q["fn_soundex"](spark, SF).collect() if names[r.k].split()[0].isalpha() and names[r.k].split()[0].isascii()}
    assert sum(v.startswith(soundex(w)[:1]) for w, v in found.items()) == len(found)


def test_box_search_against_brute_force(spark):
    r = random.Random(3)
    data = [("g", i, r.uniform(-180, 180), r.uniform(-85, 85)) for i in range(400)]
    t = spark.createDataFrame(data, "key string, member int, lon double, lat double")
    for lon, lat, radius in ((179.0, 10.0, 1500), (0.0, 84.0, 900), (-120.0, -40.0, 3000), (10.0, 0.0, 15000)):
        every = t.withColumn("d", spatial.haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) / 1000).where(F.col("d") <= radius)
        assert rows(kv.geosearch(t, lon, lat, radius, "km").select("member")) == rows(every.select("member"))
    near = rows(kv.geosearch_box(t, 0.0, 0.0, 8000, 3000, "km").select("member"))
    assert near == rows(t.where((F.abs("lat") <= 1500 / 6372.797560856 * 57.29577951308232) & (spatial.haversine(F.lit(0.0), F.col("lat"), F.col("lon"), F.col("lat")) <= 4e6)).select("member"))


def test_tokens_and_occurrences(spark):
    texts = ["The quick, a Brown fox_the übergroß x 12 not9 don't THE", "", "s t can't", "the", "然 然后 the", "andy and or ore"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fulltext.tokens(F.col("t")).alias("w"), *[fulltext.occurrences(F.lower("t"), w).alias(w) for w in ("quick", "übergroß", "not9", "andy")]).collect():
        assert r.w == [w for w in re.findall(r"[^\W_]+", r.t.lower()) if len(w) >= 2 and w not in fulltext.STOPWORDS]
        assert [r[w] for w in ("quick", "übergroß", "not9", "andy")] == [r.w.count(w) for w in ("quick", "übergroß", "not9", "andy")]
    assert fulltext.search(df.withColumn("id", F.lit(1)), "id", "t", "the a").count() == 0


def test_pruning_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 4).alias("p"), F.lit("x").alias("y")).write.partitionBy("p").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("p = 2 and id > 500").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "GreaterThan(id,500)" in plan and "y:string" not in plan
    assert len(df.inputFiles()) and df.count() == 125


def test_linear_hash_and_columns(spark):
    got = spark.range(40).select("id", partitions.by_linear_hash(F.col("id"), 6).alias("p")).collect()
    assert all(r.p == (r.id & 3 if r.id & 7 >= 6 else r.id & 7) for r in got)


def test_late_events_are_left_out(spark, tmp_path):
    from larkspur import streaming

    def batch(n, *events):
        df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in events], "event_id long, ts string, event_type string, value double")
        time.sleep(1.1)  # files come in the order of their times
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        return df

    like = batch(0, (1, "2024-01-01 00:10:00"), (2, "2024-01-01 05:00:00")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch(1, (6, "2024-01-01 05:30:00"))  # a batch sees the watermark of the one before the last
    batch(2, (3, "2024-01-01 00:20:00"), (4, "2024-01-01 05:10:00"))  # the first is later than it allows
    batch(3, (5, "2024-01-01 12:00:00"))
    out = streaming.run_once(streaming.tumbling_counts(streaming.source(spark, str(tmp_path / "s"), like, 1), late="1 hour"))
    got = {str(r.window_start): r.n for r in out.collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 3}
