"""One query for each scalar function: its value ``v`` beside the key ``k`` of each row of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.catalog import query
from larkspur.functions import dates as D
from larkspur.functions import hashes as H
from larkspur.functions import json as J
from larkspur.functions import numbers as N
from larkspur.functions import patterns as P
from larkspur.functions import spatial as G
from larkspur.functions import strings as S
from larkspur.sources import table

_KEYS = {"part": "p_partkey", "customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "nation": "n_nationkey"}


def fn(name: str, source: str, value: Callable[[], Column], oracle: str | None) -> None:
    """Register fn_<name>; without an oracle only the rows can be checked."""
    key = _KEYS[source]

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(F.col(key).alias("k"), value().alias("v"))

    query(f"fn_{name}", f"SELECT {key} AS k, {oracle} AS v FROM {source}" if oracle else None)(run)


c = F.col

# -- strings
STRINGS = [
    ("upper", lambda: F.upper("p_name"), "upper(p_name)"),
    ("lower", lambda: F.lower("p_brand"), "lower(p_brand)"),
    ("length", lambda: F.octet_length("p_name").cast("long"), "CAST(strlen(p_name) AS BIGINT)"),
    ("char_length", lambda: F.char_length("p_name").cast("long"), "CAST(length(p_name) AS BIGINT)"),
    ("concat", lambda: F.concat("p_name", F.lit("/"), F.nullif(c("p_brand"), F.lit("Brand#11"))), "p_name || '/' || nullif(p_brand, 'Brand#11')"),
    ("concat_ws", lambda: F.concat_ws("-", "p_name", F.nullif(c("p_brand"), F.lit("Brand#11")), "p_type"), "concat_ws('-', p_name, nullif(p_brand, 'Brand#11'), p_type)"),
    ("substring", lambda: S.substring(c("p_name"), c("p_size") % 5 - 2, 4), "CASE WHEN p_size % 5 - 2 = 0 THEN '' WHEN p_size % 5 - 2 > 0 THEN substr(p_name, p_size % 5 - 2, 4) ELSE substr(p_name, CAST(length(p_name) AS INT) + (p_size % 5 - 2) + 1, 4) END"),
    ("left", lambda: S.left(c("p_name"), 4), "left(p_name, 4)"),
    ("right", lambda: S.right(c("p_name"), 4), "right(p_name, 4)"),
    ("trim", lambda: S.trim(F.concat(F.lit(" \t"), c("p_name"), F.lit("\n "))), "p_name"),
    ("ltrim", lambda: S.ltrim(F.concat(F.lit(" \t"), c("p_name"))), "p_name"),
    ("rtrim", lambda: S.rtrim(F.concat(c("p_name"), F.lit(" \n"))), "p_name"),
    ("lpad", lambda: S.lpad(c("p_brand"), 12, "*-"), "lpad(p_brand, 12, '*-')"),
    ("rpad", lambda: S.rpad(c("p_brand"), 4, "*"), "rpad(p_brand, 4, '*')"),
    ("replace", lambda: F.replace(c("p_name"), F.lit("e"), F.lit("EE")), "replace(p_name, 'e', 'EE')"),
    ("locate", lambda: F.locate("a", c("p_name")).cast("long"), "CAST(strpos(p_name, 'a') AS BIGINT)"),
    ("position", lambda: F.locate("e", c("p_name"), 3).cast("long"), "CAST(CASE WHEN strpos(substr(p_name, 3), 'e') > 0 THEN strpos(substr(p_name, 3), 'e') + 2 ELSE 0 END AS BIGINT)"),
    ("instr", lambda: F.instr(c("p_name"), "o").cast("long"), "CAST(strpos(p_name, 'o') AS BIGINT)"),
    ("insert", lambda: S.insert(c("p_name"), 3, 2, "##"), "CASE WHEN length(p_name) >= 3 THEN left(p_name, 2) || '##' || substr(p_name, 5) ELSE p_name END"),
    ("repeat", lambda: S.repeat(c("p_brand"), c("p_size") % 3 - 1), "CASE WHEN p_size % 3 - 1 <= 0 THEN '' ELSE repeat(p_brand, p_size % 3 - 1) END"),
    ("reverse", lambda: F.reverse("p_name"), "reverse(p_name)"),
    ("space", lambda: F.concat(S.space(c("p_size") % 4), F.lit("|")), "repeat(' ', p_size % 4) || '|'"),
    ("format", lambda: S.format_number(c("p_retailprice") * 1000, 2), "format('{:,.2f}', round(p_retailprice * 1000, 2))"),
    ("ascii", lambda: F.ascii("p_name"), "CAST(ascii(p_name) AS INT)"),
    ("ord", lambda: S.ord_(c("p_name")), "CAST(ascii(p_name) AS BIGINT)"),
    ("char", lambda: S.char(c("p_size") % 26 + 65, F.lit(None).cast("int"), F.lit(33)), "chr(p_size % 26 + 65) || '!'"),
    ("hex", lambda: F.hex(c("p_name")), "hex(p_name)"),
    ("unhex", lambda: S.unhex(F.hex(c("p_name"))), "p_name"),
    ("bin", lambda: F.bin(c("p_size")), "bin(p_size)"),
    ("oct", lambda: S.octal(c("p_size")), "format('{:o}', p_size)"),
    ("to_base64", lambda: S.to_base64(c("p_name")), "base64(encode(p_name))"),
    ("from_base64", lambda: S.from_base64(S.to_base64(c("p_name"))), "p_name"),
    ("strcmp", lambda: S.strcmp(c("p_brand"), F.lit("Brand#3")), "CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand > 'Brand#3' THEN 1 ELSE 0 END"),
    ("soundex", lambda: F.soundex("p_name"), None),
    ("substring_index", lambda: S.substring_index(c("p_type"), " ", 1), "split_part(p_type, ' ', 1)"),
    ("elt", lambda: S.elt(c("p_size") % 4, "one", "two", "three"), "CASE p_size % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END"),
    ("field", lambda: S.field(c("p_brand"), "brand#12", "BRAND#23"), "CASE lower(p_brand) WHEN 'brand#12' THEN 1 WHEN 'brand#23' THEN 2 ELSE 0 END"),
    ("find_in_set", lambda: S.find_in_set(c("p_brand"), F.lit("Brand#11,Brand#12,Brand#13")), "CAST(coalesce(list_position(['Brand#11', 'Brand#12', 'Brand#13'], p_brand), 0) AS INT)"),
    ("export_set", lambda: S.export_set(c("p_size"), "Y", "N", "", 6), "(SELECT string_agg(CASE WHEN (p_size >> CAST(i AS INT)) & 1 = 1 THEN 'Y' ELSE 'N' END, '' ORDER BY i) FROM range(6) t(i))"),
    ("make_set", lambda: S.make_set(c("p_size"), "a", "b", "c"), "concat_ws(',', CASE WHEN p_size & 1 = 1 THEN 'a' END, CASE WHEN p_size & 2 = 2 THEN 'b' END, CASE WHEN p_size & 4 = 4 THEN 'c' END)"),
    ("quote", lambda: S.quote(F.nullif(F.concat(c("p_brand"), F.lit("'s")), F.lit("Brand#11's"))), "CASE WHEN p_brand = 'Brand#11' THEN 'NULL' ELSE '''' || p_brand || '\\''s''' END"),
    ("bit_length", lambda: F.bit_length("p_name").cast("long"), "CAST(strlen(p_name) * 8 AS BIGINT)"),
    ("weight_string", lambda: F.hex(F.encode(c("p_name"), "UTF-8")), "hex(p_name)"),
    ("like", lambda: S.like(c("p_name"), "%A_%"), "p_name ILIKE '%A_%'"),
]

# -- numbers
NUMBERS = [
    ("abs", lambda: F.abs(c("p_size") - 25).cast("double"), "CAST(abs(p_size - 25) AS DOUBLE)"),
    ("ceil", lambda: F.ceil("p_retailprice").cast("double"), "CAST(ceil(p_retailprice) AS DOUBLE)"),
    ("floor", lambda: F.floor("p_retailprice").cast("double"), "CAST(floor(p_retailprice) AS DOUBLE)"),
    ("round", lambda: F.round("p_retailprice", 1), "round(p_retailprice, 1)"),
    ("truncate", lambda: N.truncate(c("p_retailprice") - 1000, -1), "CAST(trunc((p_retailprice - 1000) / 10) * 10 AS DOUBLE)"),
    ("mod", lambda: N.mod(c("p_size") - 25, c("p_size") % 4), "CASE WHEN p_size % 4 <> 0 THEN (p_size - 25) % (p_size % 4) END"),
    ("divide", lambda: F.round(N.divide(c("p_retailprice"), c("p_size") % 4), 6), "CASE WHEN p_size % 4 <> 0 THEN round(p_retailprice / (p_size % 4), 6) END"),
    ("sign", lambda: F.signum(c("p_size") - 25).cast("int"), "CAST(sign(p_size - 25) AS INT)"),
    ("pow", lambda: F.round(F.pow(c("p_size"), F.lit(1.5)), 6), "round(pow(p_size, 1.5), 6)"),
    ("sqrt", lambda: F.round(F.sqrt("p_retailprice"), 9), "round(sqrt(p_retailprice), 9)"),
    ("exp", lambda: F.round(F.exp(c("p_size") / 50), 9), "round(exp(p_size / 50.0::DOUBLE), 9)"),
    ("log", lambda: F.round(N.log(3, c("p_retailprice")), 9), "round(ln(p_retailprice) / ln(3.0::DOUBLE), 9)"),
    ("log2", lambda: F.round(F.log2("p_retailprice"), 9), "round(log2(p_retailprice), 9)"),
    ("log10", lambda: F.round(F.log10("p_retailprice"), 9), "round(log10(p_retailprice), 9)"),
    ("ln", lambda: F.round(F.ln("p_retailprice"), 9), "round(ln(p_retailprice), 9)"),
    *[(f, (lambda f=f: F.round(getattr(F, f)(c("p_size") / 60), 9)), f"round({f}(p_size / 60.0::DOUBLE), 9)") for f in ("sin", "cos", "tan", "asin", "acos", "atan", "cot")],
    ("atan2", lambda: F.round(F.atan2(c("p_size"), F.lit(7.0)), 9), "round(atan2(p_size, 7.0::DOUBLE), 9)"),
    ("degrees", lambda: F.round(F.degrees("p_retailprice"), 6), "round(degrees(p_retailprice), 6)"),
    ("radians", lambda: F.round(F.radians("p_retailprice"), 9), "round(radians(p_retailprice), 9)"),
    ("pi", lambda: F.round(F.pi() * c("p_size"), 9), "round(pi() * p_size, 9)"),
    ("rand", lambda: F.rand(7), None),
    ("crc32", lambda: H.crc32(c("p_name")), None),
    ("conv", lambda: F.conv(c("p_size").cast("string"), 10, 16), "hex(p_size)"),
    ("greatest", lambda: N.greatest(c("p_size"), F.nullif(c("p_size") % 7, F.lit(3)), F.lit(5)), "CASE WHEN p_size % 7 <> 3 THEN greatest(p_size, p_size % 7, 5) END"),
    ("least", lambda: N.least(c("p_size"), F.nullif(c("p_size") % 7, F.lit(3)), F.lit(5)), "CASE WHEN p_size % 7 <> 3 THEN least(p_size, p_size % 7, 5) END"),
    ("bit_count", lambda: F.bit_count("p_size"), "CAST(bit_count(p_size) AS INT)"),
    ("interval", lambda: N.interval(F.nullif(c("p_size"), F.lit(9)), 10, 20, 30), "CASE WHEN p_size = 9 THEN -1 ELSE (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 30)::INT END"),
    ("to_number", lambda: N.to_number(F.right("p_brand", F.lit(3))), "coalesce(TRY_CAST(right(p_brand, 3) AS DOUBLE), 0)"),
    ("if", lambda: F.when(N.truth(c("p_size") % 3), "yes").otherwise("no"), "CASE WHEN p_size % 3 <> 0 THEN 'yes' ELSE 'no' END"),
    ("ifnull", lambda: F.coalesce(F.nullif(c("p_brand"), F.lit("Brand#11")), F.lit("none")), "coalesce(nullif(p_brand, 'Brand#11'), 'none')"),
    ("nullif", lambda: F.nullif(c("p_size") % 3, F.lit(1)), "nullif(p_size % 3, 1)"),
    ("isnull", lambda: F.isnull(F.nullif(c("p_size") % 3, F.lit(1))).cast("int"), "CAST(p_size % 3 = 1 AS INT)"),
    ("case", lambda: F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large"), "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END"),
    ("cast", lambda: F.substring("p_brand", 7, 2).try_cast("int"), "TRY_CAST(substr(p_brand, 7, 2) AS INT)"),
    ("binary", lambda: F.hex(c("p_brand").cast("binary")), "hex(p_brand)"),
]

# -- digests, identifiers, addresses, patterns
OTHERS = [
    ("md5", lambda: H.md5(c("p_name")), "md5(p_name)"),
    ("sha1", lambda: H.sha1(c("p_name")), "sha1(p_name)"),
    ("sha2", lambda: H.sha2(c("p_name"), 256), "sha256(p_name)"),
    ("aes", lambda: H.aes_decrypt(H.aes_encrypt(c("p_name"), "a secret that is long"), "a secret that is long"), "p_name"),
    ("compress", lambda: H.uncompress(H.compress(c("p_name"))), "p_name"),
    ("uncompressed_length", lambda: H.uncompressed_length(H.compress(c("p_name"))), "CAST(strlen(p_name) AS INT)"),
    ("random_bytes", lambda: F.length(H.random_bytes(8)), "8"),
    ("uuid", lambda: F.length(F.uuid()), "36"),
    ("uuid_to_bin", lambda: H.bin_to_uuid(H.uuid_to_bin(F.regexp_replace(F.md5(c("p_name")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"))), "regexp_replace(md5(p_name), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5')"),
    ("is_uuid", lambda: H.is_uuid(F.when(c("p_size") % 2 == 0, F.md5("p_name")).otherwise(c("p_name"))), "CAST(p_size % 2 = 0 AS INT)"),
    ("inet_aton", lambda: H.inet_aton(F.concat_ws(".", F.lit("10"), c("p_size").cast("string"), F.lit("3"), c("p_size").cast("string"))), "CAST(10 * 16777216 + p_size * 65536 + 3 * 256 + p_size AS BIGINT)"),
    ("inet_ntoa", lambda: H.inet_ntoa(F.lit(167772160) + c("p_size") * 65536 + 770), "'10.' || p_size || '.3.2'"),
    ("regexp_like", lambda: P.regexp_like(c("p_name"), "^[A-M].*e", "i"), "CAST(regexp_matches(p_name, '(?i)^[A-M].*e') AS INT)"),
    ("regexp_instr", lambda: P.regexp_instr(c("p_brand"), "[0-9]"), "CAST(strpos(p_brand, regexp_extract(p_brand, '[0-9]')) AS INT)"),
    ("regexp_replace", lambda: P.regexp_replace(c("p_name"), "[aeiou]", "*"), "regexp_replace(p_name, '[aeiou]', '*', 'g')"),
    ("regexp_replace_nth", lambda: P.regexp_replace(c("p_brand"), "[0-9]", "x", 1, 2), "regexp_replace(p_brand, '([0-9])[0-9]', '\\1x')"),
    ("regexp_substr", lambda: P.regexp_substr(c("p_brand"), "[0-9]", 1, 2), "nullif(regexp_extract_all(p_brand, '[0-9]')[2], '')"),
    ("database", lambda: F.current_database(), None),
    ("version", lambda: F.version(), None),
    ("current_user", lambda: F.current_user(), None),
    ("st_point", lambda: G.point(c("p_size").cast("double"), c("p_size") + 0.5), "'POINT(' || p_size || ' ' || (p_size + 0.5) || ')'"),
    ("st_x", lambda: G.x(G.point(c("p_size").cast("double"), F.lit(2.5))), "CAST(p_size AS DOUBLE)"),
    ("st_y", lambda: G.y(G.point(F.lit(2.5), c("p_size") + 0.25)), "CAST(p_size + 0.25 AS DOUBLE)"),
    ("st_distance", lambda: F.round(G.distance(G.point(c("p_size").cast("double"), F.lit(0.0)), F.lit("POINT(3 4)")), 9), "round(sqrt((p_size - 3)::DOUBLE * (p_size - 3) + 16), 9)"),
    ("st_distance_sphere", lambda: F.round(G.distance_sphere(G.point(c("p_size").cast("double"), F.lit(10.0)), F.lit("POINT(3 4)")), 3), "round(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians(4.0::DOUBLE) - radians(10.0::DOUBLE)) / 2), 2) + cos(radians(10.0::DOUBLE)) * cos(radians(4.0::DOUBLE)) * pow(sin((radians(3.0::DOUBLE) - radians(p_size::DOUBLE)) / 2), 2))), 3)"),
    ("st_contains", lambda: G.contains(F.lit("POLYGON((0 0, 20 0, 20 20, 0 20, 0 0))"), G.point(c("p_size").cast("double") + 0.5, F.lit(7.5))), "p_size + 0.5 < 20"),
    ("st_within", lambda: G.within(G.point(c("p_size").cast("double") + 0.5, F.lit(7.5)), F.lit("POLYGON((0 0, 20 0, 20 20, 0 20, 0 0))")), "p_size + 0.5 < 20"),
    ("st_geomfromtext", lambda: G.from_text(F.concat(F.lit(" point( "), c("p_size").cast("string"), F.lit("   2.5 )"))), "'POINT(' || p_size || ' 2.5)'"),
    ("charset", lambda: S.charset(F.nullif(c("p_size"), F.lit(7)).cast("string")), "CASE WHEN p_size = 7 THEN 'binary' ELSE 'utf8mb4' END"),
    ("collation", lambda: S.collation(F.nullif(c("p_size"), F.lit(7)).cast("string")), "CASE WHEN p_size = 7 THEN 'binary' ELSE 'utf8mb4_general_ci' END"),
    ("coercibility", lambda: S.coercibility(c("p_name")), "2"),
    ("uuid_short", lambda: (H.uuid_short() >= 0).cast("int"), "1"),
    ("session_user", lambda: F.expr("session_user()"), None),
    ("cast_decimal", lambda: c("p_retailprice").cast("string").try_cast("decimal(12,1)").cast("double"), "CAST(TRY_CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(12, 1)) AS DOUBLE)"),
    ("cast_date", lambda: F.concat(F.lit("2024-01-"), F.lpad(c("p_size").cast("string"), 2, "0")).try_cast("date"), "TRY_CAST('2024-01-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DATE)"),
    ("cast_char", lambda: F.substring(c("p_name"), 1, 5), "substr(p_name, 1, 5)"),
    ("st_intersects", lambda: G.intersects(G.point(c("p_size").cast("double"), F.lit(1.0)), F.lit("POINT(7 1)")), "p_size = 7"),
    ("st_srid", lambda: G.srid(F.lit("POINT(1 1)")), "0"),
    ("st_astext", lambda: G.point(c("p_size").cast("double"), F.lit(1.0)), "'POINT(' || p_size || ' 1)'"),
    ("geohash", lambda: G.geohash(c("p_size") * 3.0 - 70, c("p_size") * 1.5 - 30), None),
]
for _name, _value, _oracle in STRINGS + NUMBERS + OTHERS:
    fn(_name, "part", _value, _oracle)

_d = "o_orderdate"
_DAY = "CAST(o_orderdate AS DATE)"
_SUNDAY = f"({_DAY} - CAST(dayofweek({_DAY}) AS INT))"
_WEEK = "CAST(floor((dayofyear({0}) + 6 - dayofweek({0})) / 7.0) AS INT)"
DATES = [
    *[(f, (lambda g=g: g(_d)), f"CAST({f}(o_orderdate) AS INT)") for f, g in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour), ("minute", F.minute), ("second", F.second), ("dayofyear", F.dayofyear), ("quarter", F.quarter), ("weekofyear", F.weekofyear))],
    ("microsecond", lambda: D.microsecond(c(_d)), "CAST(microsecond(o_orderdate) % 1000000 AS INT)"),
    ("dayofweek", lambda: F.dayofweek(_d), "CAST(dayofweek(o_orderdate) + 1 AS INT)"),
    ("weekday", lambda: D.weekday(c(_d)), "CAST((dayofweek(o_orderdate) + 6) % 7 AS INT)"),
    ("week", lambda: D.week(c(_d)), _WEEK.format(_DAY)),
    ("yearweek", lambda: D.yearweek(c(_d)), f"CAST(year({_SUNDAY}) * 100 + {_WEEK.format(_SUNDAY)} AS INT)"),
    ("dayname", lambda: D.dayname(c(_d)), "dayname(o_orderdate)"),
    ("monthname", lambda: D.monthname(c(_d)), "monthname(o_orderdate)"),
    ("date", lambda: F.to_date(_d), "CAST(o_orderdate AS DATE)"),
    ("time", lambda: F.date_format(_d, "HH:mm:ss"), "strftime(o_orderdate, '%H:%M:%S')"),
    ("date_add", lambda: D.date_add(c(_d), F.col("o_orderkey") % 40, "MONTH"), "o_orderdate + to_months(CAST(o_orderkey % 40 AS INT))"),
    ("date_sub", lambda: D.date_sub(c(_d), F.col("o_orderkey") % 400, "DAY"), "o_orderdate - to_days(CAST(o_orderkey % 400 AS INT))"),
    ("date_add_hours", lambda: D.date_add(c(_d), F.col("o_orderkey") % 400 - 200, "HOUR"), "o_orderdate + to_hours(o_orderkey % 400 - 200)"),
    ("addtime", lambda: D.addtime(c(_d), "30:10:05"), "o_orderdate + INTERVAL 108605 SECOND"),
    ("subtime", lambda: D.addtime(c(_d), "30:10:05", -1), "o_orderdate - INTERVAL 108605 SECOND"),
    ("datediff", lambda: D.datediff(c(_d), F.lit("1995-06-17").cast("date")), "CAST(date_diff('day', DATE '1995-06-17', o_orderdate::DATE) AS INT)"),
    ("timediff", lambda: D.timediff(D.date_add(c(_d), c("o_orderkey") % 90000, "SECOND"), c(_d)), "printf('%02d:%02d:%02d', (o_orderkey % 90000) // 3600, (o_orderkey % 90000) // 60 % 60, (o_orderkey % 90000) % 60)"),
    ("timestampdiff", lambda: D.timestampdiff("MONTH", F.lit("1992-01-31").cast("timestamp_ntz"), c(_d)), "CAST(date_sub('month', TIMESTAMP '1992-01-31', o_orderdate) AS BIGINT)"),
    ("timestampadd", lambda: D.date_add(c(_d), 3, "QUARTER"), "o_orderdate + INTERVAL 9 MONTH"),
    ("date_format", lambda: D.date_format(c(_d), "%W, %e %M %Y %H:%i:%s (%j)"), "strftime(o_orderdate, '%A, ') || day(o_orderdate) || strftime(o_orderdate, ' %B %Y %H:%M:%S (%j)')"),
    ("time_format", lambda: D.date_format(c(_d), "%h.%i %p"), "strftime(o_orderdate, '%I.%M %p')"),
    ("str_to_date", lambda: D.str_to_date(F.when(c("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format(_d, "dd/MM/yyyy HH:mm")), "%d/%m/%Y %H:%i"), "CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('minute', o_orderdate) END"),
    ("get_format", lambda: D.get_format("DATE", "EUR"), "'%d.%m.%Y'"),
    ("unix_timestamp", lambda: D.unix_timestamp(c(_d)), "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("from_unixtime", lambda: D.from_unixtime(c("o_orderkey") * 86399), "make_timestamp(o_orderkey * 86399000000)"),
    ("to_days", lambda: D.to_days(c(_d)), "CAST(date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719528 AS BIGINT)"),
    ("from_days", lambda: D.from_days(F.lit(719528) + c("o_orderkey")), "CAST(DATE '1970-01-01' + CAST(o_orderkey AS INT) AS DATE)"),
    ("to_seconds", lambda: D.to_seconds(c(_d)), "CAST(719528::BIGINT * 86400 + epoch(o_orderdate) AS BIGINT)"),
    ("sec_to_time", lambda: D.sec_to_time(c("o_orderkey") * 7), "printf('%02d:%02d:%02d', (o_orderkey * 7) // 3600, (o_orderkey * 7) // 60 % 60, (o_orderkey * 7) % 60)"),
    ("time_to_sec", lambda: D.time_to_sec(c(_d)), "CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS BIGINT)"),
    ("makedate", lambda: D.makedate(F.year(_d), F.dayofyear(_d)), "CAST(o_orderdate AS DATE)"),
    ("maketime", lambda: D.maketime(c("o_orderkey") % 120, c("o_orderkey") % 60, c("o_orderkey") % 61), "CASE WHEN o_orderkey % 61 < 60 THEN printf('%02d:%02d:%02d', o_orderkey % 120, o_orderkey % 60, o_orderkey % 61) END"),
    ("last_day", lambda: F.last_day(_d), "last_day(o_orderdate)"),
    ("period_add", lambda: D.period_add(F.year(_d) * 100 + F.month(_d), 17), "CAST(strftime(o_orderdate + INTERVAL 17 MONTH, '%Y%m') AS BIGINT)"),
    ("period_diff", lambda: D.period_diff(F.year(_d) * 100 + F.month(_d), F.lit(199203)), "CAST(date_diff('month', DATE '1992-03-01', o_orderdate) AS BIGINT)"),
    ("convert_tz", lambda: D.convert_tz(c(_d), "+00:00", "+05:30"), "o_orderdate + INTERVAL 330 MINUTE"),
    ("extract", lambda: D.extract("YEAR_MONTH", c(_d)), "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)"),
    ("timestamp", lambda: D.moment(F.date_format(_d, "yyyy-MM-dd HH:mm:ss")), "date_trunc('second', o_orderdate)"),
    ("now", lambda: F.localtimestamp(), None),
    ("utc_date", lambda: F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), None),
    ("utc_timestamp", lambda: F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), None),
    ("utc_time", lambda: F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "HH:mm:ss"), None),
    ("curtime", lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"), None),
    ("curdate", lambda: F.current_date(), None),
]
for _name, _value, _oracle in DATES:
    fn(_name, "orders", _value, _oracle)

_p = "props"
JSON = [
    ("json_extract", lambda: J.extract(c(_p), "$.k"), "props->>'$.k'"),
    ("json_unquote", lambda: J.unquote(F.concat(F.lit('"'), c("event_type"), F.lit('"'))), "event_type"),
    ("json_object", lambda: J.extract(J.object_(("id", c("event_id"), "bigint"), ("t", c("event_type"), "string")), "$.t"), "event_type"),
    ("json_array", lambda: J.array((c("event_id"), "bigint"), (c("event_type"), "string"), (F.lit(None).cast("int"), "int")), "'[' || event_id || ',\"' || event_type || '\",null]'"),
    ("json_set", lambda: J.extract(J.set_(c(_p), ("$.k", 5), ("$.new.x", 1), ("$.z", "a")), "$.k"), "CASE WHEN props IS NOT NULL THEN '5' END"),
    ("json_insert", lambda: J.extract(J.insert(c(_p), ("$.k", 5), ("$.z", "a")), "$.k"), "props->>'$.k'"),
    ("json_replace", lambda: J.extract(J.replace(c(_p), ("$.k", 5), ("$.z", "a")), "$.k"), "CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN '5' END"),
    ("json_remove", lambda: J.length(J.remove(c(_p), "$.k")), "CAST(len(json_keys(props)) - (json_extract(props, '$.k') IS NOT NULL)::INT AS INT)"),
    ("json_keys", lambda: J.keys(c(_p)), "CAST(to_json(json_keys(props)) AS VARCHAR)"),
    ("json_length", lambda: J.length(c(_p)), "CAST(len(json_keys(props)) AS INT)"),
    ("json_valid", lambda: J.valid(F.when(c("event_id") % 3 == 0, "{bad").otherwise(c(_p))), "CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(coalesce(json_valid(props), false) AS INT) END"),
    ("json_type", lambda: J.type_(c(_p)), "json_type(props)"),
    ("json_contains", lambda: J.contains(c(_p), F.lit('{"k": 7}')), "CAST(coalesce(props->>'$.k' = '7', false) AS INT)"),
    ("json_contains_path", lambda: J.contains_path(c(_p), "one", "$.nope", "$.k"), "CAST(json_extract(props, '$.k') IS NOT NULL AS INT)"),
    ("json_search", lambda: J.search(J.object_(("a", F.lit("x"), "string"), ("t", c("event_type"), "string")), "one", "%i%"), "CASE WHEN event_type ILIKE '%i%' THEN '\"$.t\"' END"),
    ("json_merge_patch", lambda: J.extract(J.merge_patch(c(_p), F.lit('{"k": null, "b": {"c": 1}}')), "$.b.c"), "CASE WHEN props IS NOT NULL THEN '1' END"),
    ("json_merge_preserve", lambda: J.extract(J.merge_preserve(c(_p), F.lit('{"k": "x"}')), "$.k[1]"), "CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN 'x' END"),
]
for _name, _value, _oracle in JSON:
    fn(_name, "events", _value, _oracle)
