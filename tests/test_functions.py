"""Corner cases of the compatibility functions, operators and structures on literal data."""

import pytest
from pyspark.sql import functions as F

from larkspur import dialect, kv
from larkspur.functions import dates, hashes, json, numbers, patterns, spatial, strings
from larkspur.operators import dml, subqueries


def lit(x):
    return F.lit(x)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cases():
    return [
        (strings.substring(lit("abc"), 0, 2), ""), (strings.substring(lit("abcdef"), -3, 2), "de"), (strings.lpad(lit("abc"), -1, "x"), None),
        (strings.lpad(lit("abc"), 2, "x"), "ab"), (strings.insert(lit("Quadratic"), 3, 4, "What"), "QuWhattic"), (strings.insert(lit("abc"), 9, 1, "x"), "abc"),
        (strings.field(lit(None).cast("string"), "a"), 0), (strings.elt(lit(4), "a", "b"), None), (strings.quote(lit("a'b\n")), "'a\\'b\\n'"), (strings.quote(lit(None).cast("string")), "NULL"),
        (strings.export_set(lit(5), "Y", "N", ",", 4), "Y,N,Y,N"), (strings.make_set(lit(5), "a", "b", "c"), "a,c"), (strings.trim(lit(" \t x \n")), "x"),
        (strings.ord_(lit("é")), 0xC3A9), (strings.format_number(lit(1234.5), 0), "1,235"),
        (numbers.divide(lit(7), 0), None), (numbers.mod(lit(-7), 3), -1), (numbers.truncate(lit(-1.999), 1), -1.9), (numbers.truncate(lit(199.0), -2), 100.0),
        (numbers.greatest(lit(1), lit(None).cast("int")), None), (numbers.interval(lit(22), 23, 30, 44), 0), (numbers.interval(lit(None).cast("int"), 1), -1), (numbers.to_number(lit("12abc")), 0.0), (numbers.log(10, lit(-1.0)), None),
        (dates.date_format(lit("2024-01-02 03:04:05").cast("timestamp_ntz"), "%D %w %U"), "2nd 2 00"), (dates.timestampdiff("MONTH", lit("2024-01-31").cast("timestamp_ntz"), lit("2024-02-01").cast("timestamp_ntz")), 0),
        (dates.period_add(lit(200801), 2), 200803), (dates.period_diff(lit(200802), lit(200703)), 11), (dates.sec_to_time(lit(-3661)), "-01:01:01"), (dates.sec_to_time(lit(360000)), "100:00:00"),
        (dates.to_days(lit("1970-01-01").cast("timestamp_ntz")), 719528), (dates.str_to_date(lit("nonsense"), "%Y-%m-%d"), None), (dates.extract("DAY_MINUTE", lit("2024-01-02 03:04:05").cast("timestamp_ntz")), 20304),
        (json.valid(lit("{bad")), 0), (json.valid(lit(None).cast("string")), 0), (json.type_(lit("[1]")), "ARRAY"), (json.type_(lit("null")), "NULL"), (json.length(lit('{"a":1,"b":2}')), 2), (json.length(lit("3")), 1),
        (json.set_(lit('{"a":{"b":1}}'), ("$.a.b", 2), ("$.c", [1])), '{"a":{"b":2},"c":[1]}'), (json.insert(lit('{"a":1}'), ("$.a", 2)), '{"a":1}'), (json.remove(lit('{"a":[1,2]}'), "$.a[0]"), '{"a":[2]}'),
        (json.merge_patch(lit('{"a":1,"b":2}'), lit('{"a":null}')), '{"b":2}'), (json.merge_preserve(lit('{"a":1}'), lit('{"a":2}')), '{"a":[1,2]}'), (json.contains(lit("[1,[2]]"), lit("[1]")), 1), (json.contains(lit("{bad"), lit("1")), None),
        (json.search(lit('{"a":["xy","Xz"]}'), "all", "x%"), '["$.a[0]","$.a[1]"]'), (json.unquote(lit('"a\\"b"')), 'a"b'),
        (patterns.regexp_instr(lit("dog cat dog"), "dog", 1, 2), 9), (patterns.regexp_instr(lit("dog"), "cat"), 0), (patterns.regexp_instr(lit("dog cat"), "dog", 1, 1, 1), 4), (patterns.regexp_replace(lit("a b c"), "[a-z]", "X", 1, 3), "a b X"), (patterns.regexp_substr(lit("abc def"), "[a-z]+", 1, 2), "def"), (patterns.regexp_substr(lit("1"), "[a-z]+"), None),
        (hashes.inet_aton(lit("1.2.3.4")), 16909060), (hashes.inet_aton(lit("1.2.3.400")), None), (hashes.inet_ntoa(lit(16909060)), "1.2.3.4"), (hashes.uncompress(lit("no")), None), (hashes.is_uuid(lit("x")), 0),
        (spatial.x(lit("POINT(1.5 -2)")), 1.5), (spatial.x(lit("LINESTRING(0 0, 1 1)")), None), (spatial.contains(lit("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), lit("POINT(5 1)")), False), (spatial.geohash(lit(-5.6), lit(42.6), 5), "ezs42"),
    ]


def test_values(spark):
    todo = cases()
    row = spark.range(1).select(*[column.alias(f"v{i}") for i, (column, _) in enumerate(todo)]).first()
    for i, (column, want) in enumerate(todo):
        assert row[i] == (pytest.approx(want) if isinstance(want, float) else want), str(column)


def test_round_trips(spark):
    assert one(spark, hashes.aes_decrypt(hashes.aes_encrypt(lit("text"), "key"), "key")) == "text"
    assert one(spark, hashes.uncompress(hashes.compress(lit("é" * 99)))) == "é" * 99
    assert one(spark, dates.str_to_date(lit("02/01/2024"), "%d/%m/%Y")).isoformat() == "2024-01-02T00:00:00"


def test_quantified_with_nothing_and_nulls(spark):
    df, none = spark.createDataFrame([(1,), (5,)], "x int"), spark.createDataFrame([], "y int")
    some = spark.createDataFrame([(2,), (None,)], "y int")
    assert subqueries.compare_all(df, "x", ">", none, "y").count() == 2
    assert subqueries.compare_all(df, "x", ">", some, "y").count() == 0
    assert [r.x for r in subqueries.compare_any(df, "x", ">", some, "y").collect()] == [5]
    assert subqueries.compare_any(df, "x", "=", none, "y").count() == 0


def test_foreign_keys(spark):
    parent, child = spark.createDataFrame([(1,)], "p int"), spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, k int")
    assert [r.id for r in dml.violations(child, "k", parent, "p").collect()] == [2]
    assert sorted(r.id for r in dml.cascade_delete(child, "k", parent, "p").collect()) == [1, 3]
    assert sorted((r.id, r.k) for r in dml.set_null(child, "k", parent, "p").collect() if r.k is None) == [(2, None), (3, None)]
    with pytest.raises(dml.ConstraintError):
        dml.require(dml.violations(child, "k", parent, "p"), "orphans")


def test_lists_and_sorted_sets(spark):
    lists = spark.createDataFrame([("a", i, v) for i, v in enumerate("xyxz")], "key string, pos long, value string")
    assert [r.value for r in kv.lrange(lists, -2, -1).orderBy("pos").collect()] == ["x", "z"]
    assert [r.place for r in kv.lpos(lists, "x", -1).collect()] == [2]
    more = kv.push(lists, spark.createDataFrame([("a", 1, "p"), ("a", 2, "q")], "key string, ord int, value string"), left=True)
    assert [r.value for r in more.orderBy("pos").collect()] == ["q", "p", "x", "y", "x", "z"]
    z = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("k", "c", 0.5)], "key string, member string, score double")
    assert [r.member for r in kv.zrange(z, 0, -1).orderBy("rank").collect()] == ["c", "a", "b"]
    assert kv.zcount(z, "(0.5", "+inf").first().n == 2
    assert {(r.member, r.score) for r in kv.zadd(z, spark.createDataFrame([("k", "a", 0.1), ("k", "d", 9.0)], z.schema), "xx").collect()} == {("a", 0.1), ("b", 1.0), ("c", 0.5)}


def test_bits_streams_and_keys(spark):
    bits = spark.createDataFrame([("a", 1), ("a", 9), ("b", 9)], "key string, bit int")
    assert [r.bit for r in kv.bitop("xor", bits, "a", "b").collect()] == [1]
    assert {r.key: r.n for r in kv.bitcount(bits, 1, 1).collect()} == {"a": 1, "b": 1}
    log = kv.xadd(spark.createDataFrame([("s", 5, 1, "x"), ("s", 5, 2, "y"), ("s", 6, 3, "z")], "key string, ms long, ord int, fields string"))
    assert [(r.ms, r.seq) for r in kv.xread(log, (5, 0)).orderBy("ms", "seq").collect()] == [(5, 1), (6, 0)]
    assert [r.key for r in kv.keys(spark.createDataFrame([("h.llo",), ("hello",)], "key string"), "h?llo").orderBy("key").collect()] == ["h.llo", "hello"]
    estimate = kv.pfcount(kv.pfadd(spark.range(20000).select(lit("k").alias("key"), F.col("id").alias("value")))).first().estimate
    assert abs(estimate - 20000) < 1000


def test_dialect():
    assert dialect.translate("SELECT TOP 3 [a b], LEN(N'[x] TOP 1') FROM dbo.t") == "SELECT `a b`, char_length('[x] TOP 1') FROM t LIMIT 3"
