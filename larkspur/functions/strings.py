"""String functions with MySQL semantics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def any_null(*cols: Column) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | _c(c).isNull()
    return out


def substring(s: Column, pos, length=None) -> Column:
    """1-based; a negative position counts from the end; position 0 gives an empty string."""
    pos, n = _c(pos), F.char_length(s)
    start = F.when(pos < 0, n + pos + 1).otherwise(pos)
    size = _c(length) if length is not None else n
    ok = (start >= 1) & (start <= n) & (size > 0)
    return F.when(any_null(s, pos, size), None).when(ok, F.substring(s, start, size)).otherwise("")


def left(s: Column, n) -> Column:
    return F.left(s, _c(n))


def right(s: Column, n) -> Column:
    return F.right(s, _c(n))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, r"\s+$", "")


def _pad(f, s: Column, n: int, pad: str) -> Column:
    """Cuts what is longer; null for a negative length or an empty pad."""
    return F.lit(None).cast("string") if n < 0 or pad == "" else f(s, n, pad)


def lpad(s: Column, n: int, pad: str) -> Column:
    return _pad(F.lpad, s, n, pad)


def rpad(s: Column, n: int, pad: str) -> Column:
    return _pad(F.rpad, s, n, pad)


def insert(s: Column, pos: int, length: int, new) -> Column:
    """s with length characters from pos replaced; s itself where pos is outside."""
    inside = F.lit(pos) <= F.char_length(s) if pos >= 1 else F.lit(False)
    return F.when(inside, F.overlay(s, _c(new), pos, length if length >= 0 else -1)).otherwise(s)


def repeat(s: Column, n) -> Column:
    return F.repeat(s, F.greatest(_c(n), F.lit(0)))


def space(n) -> Column:
    return repeat(F.lit(" "), n)


def format_number(x: Column, digits: int) -> Column:
    """Thousands separators, rounded half away from zero."""
    return F.format_number(F.round(x, digits), digits)


def ord_(s: Column) -> Column:
    """The UTF-8 bytes of the first character as a number."""
    return F.conv(F.hex(F.left(s, F.lit(1))), 16, 10).cast("long")


def char(*codes: Column) -> Column:
    return F.concat(*[F.coalesce(F.chr(c), F.lit("")) for c in codes])


def unhex(s: Column) -> Column:
    return F.decode(F.unhex(s), "UTF-8")


def to_base64(s: Column) -> Column:
    return F.base64(F.encode(s, "UTF-8"))


def from_base64(s: Column) -> Column:
    return F.decode(F.try_to_binary(s, F.lit("base64")), "UTF-8")


def octal(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 8)


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def elt(n: Column, *items) -> Column:
    return F.when((n >= 1) & (n <= len(items)), F.try_element_at(F.array(*map(_c, items)), n.cast("int")))


def field(s: Column, *items) -> Column:
    """Position of s among the items without regard to case; 0 if absent or null."""
    return F.coalesce(F.array_position(F.array(*[F.lower(_c(i)) for i in items]), F.lower(s)), F.lit(0)).cast("int")


def find_in_set(s: Column, items: Column) -> Column:
    return F.find_in_set(s, items)


def bit(n: Column, i) -> Column:
    return F.shiftright(n.cast("long"), i).bitwiseAND(F.lit(1)) == 1


def export_set(bits: Column, on: str, off: str, sep: str = ",", n: int = 64) -> Column:
    return F.concat_ws(sep, *[F.when(bit(bits, i), on).otherwise(off) for i in range(n)])


def make_set(bits: Column, *items) -> Column:
    return F.when(bits.isNull(), None).otherwise(F.concat_ws(",", *[F.when(bit(bits, i), _c(x)) for i, x in enumerate(items)]))


#: Characters that QUOTE escapes, and what they become.
_ESCAPES = (("\\", "\\\\"), ("'", "\\'"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("\x1a", "\\Z"))


def quote(s: Column) -> Column:
    out = s
    for a, b in _ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), out, F.lit("'")), F.lit("NULL"))


def substring_index(s: Column, delimiter: str, n: int) -> Column:
    return F.substring_index(s, delimiter, n)


def like(s: Column, pattern: str) -> Column:
    return s.ilike(pattern)


def charset(s: Column) -> Column:
    return F.when(s.isNull(), "binary").otherwise("utf8mb4")


def collation(s: Column) -> Column:
    return F.when(s.isNull(), "binary").otherwise("utf8mb4_general_ci")


def coercibility(s: Column) -> Column:
    return F.lit(2)
