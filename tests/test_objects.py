"""Events, cursors, declared indexes, stream groups, and plans that read less."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur import catalog, kv
from larkspur.operators.events import EventError, Events, parse_event
from larkspur.operators.handler import Handler, HandlerError

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_events(spark):
    events = Events(spark)
    events.create("CREATE EVENT once ON SCHEDULE AT '2024-01-01 00:10:00' DO SELECT 1 AS v", T0)
    events.create("CREATE EVENT kept ON SCHEDULE AT '2024-01-01 00:05:00' ON COMPLETION PRESERVE ENABLE COMMENT 'x' DO SELECT 2 AS v", T0)
    events.create("CREATE EVENT off ON SCHEDULE EVERY 1 SECOND DISABLE DO SELECT 3 AS v", T0)
    events.create("CREATE EVENT often ON SCHEDULE EVERY 15 MINUTE STARTS '2024-01-01 00:15:00' ENDS '2024-01-01 01:00:00' DO SELECT 4 AS v", T0)
    assert events.run(T0) == []
    ran = events.run(T0 + timedelta(minutes=50))
    assert [(n, df.first().v) for n, df in ran] == [("kept", 2), ("once", 1), ("often", 4)]
    assert set(events.held) == {"kept", "off", "often"}
    assert events.held["often"].due() == T0 + timedelta(hours=1) and events.held["kept"].due() is None
    assert [n for n, _ in events.run(T0 + timedelta(hours=1))] == ["often"] and "often" not in events.held
    with pytest.raises(EventError):
        events.create("CREATE EVENT OFF ON SCHEDULE EVERY 1 DAY DO SELECT 1", T0)
    events.create("CREATE OR REPLACE EVENT off ON SCHEDULE EVERY 1 DAY DO SELECT 5 AS v", T0)
    assert events.run(T0)[0][1].first().v == 5
    for text in ("SELECT 1", "CREATE EVENT e ON SCHEDULE EVERY 0 DAY DO SELECT 1", "CREATE EVENT e ON SCHEDULE EVERY 2 FORTNIGHT DO SELECT 1"):
        with pytest.raises(EventError):
            parse_event(text, T0)
    with pytest.raises(EventError):
        events.drop("none")
    events.drop("none", if_exists=True)


def test_handler(spark):
    h = Handler(spark.range(10).repartition(3), "id")
    ids = lambda *a, **k: [r.id for r in h.read(*a, **k)]
    assert ids("prev") == [] and ids("next", 2) == [0, 1] and ids("next") == [2] and ids("prev", 5) == [1, 0] and ids("prev") == []
    assert ids("last", 2) == [9, 8] and ids("next") == [9] and ids("next") == [] and ids("first", where=F.col("id") > 4) == [5]
    with pytest.raises(HandlerError):
        h.read("sideways")
    h.close()
    with pytest.raises(HandlerError):
        h.read()


def test_stream_groups(spark):
    s = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("b", 5, 0)], "key string, ms long, seq long")
    none = spark.createDataFrame([], "key string, grp string, last_ms long, last_seq long")
    groups = kv.xgroup_create(none, s, "g", (1, 0))
    given, groups = kv.xreadgroup(s, groups, "g", "me", 1, F.lit(9))
    assert sorted(map(tuple, given.select("key", "ms", "seq", "deliveries").collect())) == [("a", 1, 1, 1), ("b", 5, 0, 1)]
    assert sorted(map(tuple, groups.collect())) == [("a", "g", 1, 1), ("b", "g", 5, 0)]
    rest, groups = kv.xreadgroup(s, groups, "g", "me", 9, F.lit(9))
    assert [tuple(r) for r in rest.select("key", "ms", "seq").collect()] == [("a", 2, 0)]
    left, done = kv.xack(given.union(rest), spark.createDataFrame([("a", "g", 1, 1), ("a", "g", 7, 7)], "key string, grp string, ms long, seq long"))
    assert left.count() == 2 and [tuple(r) for r in done.collect()] == [("a", "g", 1)]
    assert sorted(r.last_ms for r in kv.xgroup_create(none, s, "new").collect()) == [2, 5]


def test_plans_read_less(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "might_contain" in catalog.queries()["join_bloom"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    zones = catalog.queries()["scan_zones"](spark, SF)
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan(zones)
    # Each file has a range of keys of its own, so only the files of this range have rows to give.
    files = spark.read.parquet(*zones.inputFiles()).groupBy(F.col("_metadata.file_path")).agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).orderBy("low").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:], strict=False))


def test_distinct_counts_of_analyze(spark):
    from larkspur.plans.ddl import _database, _two_tables
    from larkspur.sources import ddl

    with _database(spark) as db:
        _two_tables(spark, db, SF)
        got = {r.column_name: r.distinct_count for r in ddl.analyze(spark, f"{db}.land").collect()}
        assert got["n_regionkey"] == 5 and abs(got["n_nationkey"] - 25) <= 2
        with pytest.raises(ValueError):
            ddl.create_index(spark, f"{db}.land", "by_name", ["n_name"])
        with pytest.raises(ValueError):
            ddl.create_index(spark, f"{db}.land", "other", ["none"])
        with pytest.raises(ValueError):
            ddl.drop_index(spark, f"{db}.land", "other")
