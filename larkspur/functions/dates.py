"""Date and time functions with MySQL semantics. A value that is no date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.strings import _c

#: Format codes with a pattern letter of their own.
_PATTERNS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a"}


def moment(x: Column) -> Column:
    return x.try_cast("timestamp_ntz")


def week(d: Column) -> Column:
    """Sunday-first week of the year; days before the first Sunday are in week 0."""
    return F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7).cast("int")


def yearweek(d: Column) -> Column:
    """The year and week of the Sunday that begins d's week."""
    sunday = F.date_sub(d.cast("date"), F.dayofweek(d) - 1)
    return (F.year(sunday) * 100 + week(sunday)).cast("int")


def weekday(d: Column) -> Column:
    return F.weekday(d)


def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def microsecond(d: Column) -> Column:
    return F.date_format(d, "SSSSSS").cast("int")


def ordinal_day(d: Column) -> Column:
    n = F.dayofmonth(d)
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def date_format(d: Column, fmt: str) -> Column:
    """Format codes as MySQL has them; the format is a literal."""
    parts, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            code = fmt[i + 1]
            special = {"D": ordinal_day, "w": lambda x: (F.dayofweek(x) - 1).cast("string"), "U": lambda x: _two(week(x)), "u": lambda x: _two(F.weekofyear(x)), "v": lambda x: _two(F.weekofyear(x)), "V": lambda x: F.right(yearweek(x).cast("string"), F.lit(2)), "X": lambda x: F.left(yearweek(x).cast("string"), F.lit(4)), "x": lambda x: F.extract(F.lit("YEAROFWEEK"), x).cast("string")}
            if code in special:
                parts.append(special[code](d))
            elif code in _PATTERNS:
                parts.append(F.date_format(d, _PATTERNS[code]))
            else:
                parts.append(F.lit(code))
            i += 2
        else:
            parts.append(F.lit(fmt[i]))
            i += 1
    return F.concat(*parts)


def str_to_date(s: Column, fmt: str) -> Column:
    """Null where the text does not follow the format."""
    pattern, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            pattern += _PATTERNS.get(fmt[i + 1], fmt[i + 1])
            i += 2
        else:
            pattern += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")


def date_add(d: Column, n, unit: str = "DAY") -> Column:
    """Month ends clamp."""
    unit = unit.upper()
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}
    micros = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
    if unit in months:
        return moment(d) + F.make_ym_interval(F.lit(0), (_c(n) * months[unit]).cast("int"))
    span = _c(n).cast("long") * micros[unit]
    days, rest = F.floor(span / (86400 * 10**6)).cast("int"), F.pmod(span, F.lit(86400 * 10**6))
    return moment(d) + F.make_dt_interval(days, F.lit(0), F.lit(0), (rest / 10**6).cast("decimal(18,6)"))


def date_sub(d: Column, n, unit: str = "DAY") -> Column:
    return date_add(d, -_c(n), unit)


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def _micros(d: Column) -> Column:
    return F.unix_micros(moment(d).cast("timestamp"))


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units that have passed from a to b."""
    unit = unit.upper()
    size = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
    if unit in size:
        span = _micros(b) - _micros(a)
        return (F.signum(span) * F.floor(F.abs(span) / size[unit])).cast("long")
    months = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}[unit]
    whole = F.months_between(moment(b).cast("timestamp"), moment(a).cast("timestamp"))
    return (F.signum(whole) * F.floor(F.abs(whole) / months)).cast("long")


def sec_to_time(n: Column) -> Column:
    """[-]HH:MM:SS, hours beyond 24 allowed."""
    a = F.abs(n)
    return F.concat(F.when(n < 0, "-").otherwise(""), _hours(F.floor(a / 3600)), F.lit(":"), _two(F.floor(a / 60) % 60), F.lit(":"), _two(a % 60))


def _hours(h: Column) -> Column:
    return F.when(h < 100, _two(h)).otherwise(h.cast("string"))


def time_to_sec(t: Column) -> Column:
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")


def timediff(a: Column, b: Column) -> Column:
    return sec_to_time(F.floor((_micros(a) - _micros(b)) / 10**6))


def addtime(d: Column, time: str, sign: int = 1) -> Column:
    h, m, s = (int(x) for x in time.split(":"))
    return date_add(d, sign * (h * 3600 + m * 60 + s), "SECOND")


def to_days(d: Column) -> Column:
    return (F.datediff(d.cast("date"), F.lit("0001-01-01").cast("date")) + 366).cast("long")


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (n - 366).cast("int"))


def to_seconds(d: Column) -> Column:
    return to_days(d) * 86400 + time_to_sec(d)


def unix_timestamp(d: Column) -> Column:
    return F.floor(_micros(d) / 10**6).cast("long")


def from_unixtime(n: Column) -> Column:
    return F.timestamp_seconds(n).cast("timestamp_ntz")


def makedate(year: Column, day: Column) -> Column:
    return F.when(day > 0, F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int")))


def maketime(h: Column, m: Column, s: Column) -> Column:
    return F.when(m.between(0, 59) & s.between(0, 59), F.concat(F.when(h < 0, "-").otherwise(""), _hours(F.abs(h)), F.lit(":"), _two(m), F.lit(":"), _two(s)))


def _period_months(p: Column) -> Column:
    year = F.floor(p / 100)
    year = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return year * 12 + p % 100 - 1


def period_add(p: Column, n) -> Column:
    m = _period_months(p) + _c(n)
    return (F.floor(m / 12) * 100 + m % 12 + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return (_period_months(a) - _period_months(b)).cast("long")


def convert_tz(d: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), moment(d))


_COMPOSITE = {
    "YEAR_MONTH": ("YEAR", "MONTH"), "DAY_HOUR": ("DAY", "HOUR"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"),
}
_PLAIN = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "QUARTER": F.quarter, "WEEK": week, "MICROSECOND": microsecond}


def extract(unit: str, d: Column) -> Column:
    unit = unit.upper()
    out = None
    for part in _COMPOSITE.get(unit, (unit,)):
        out = _PLAIN[part](d) if out is None else out * 100 + _PLAIN[part](d)
    return out.cast("long")


#: What GET_FORMAT answers, by type and standard.
FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}


def get_format(kind: str, standard: str) -> Column:
    return F.lit(FORMATS.get((kind.upper(), standard.upper())))
