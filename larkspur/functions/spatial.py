"""Spatial functions over WKT text, and the key-value store's geo formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres: the sphere of ST_DISTANCE_SPHERE and that of the geo commands, and their units.
SPHERE = 6371000.0
GEO_SPHERE = 6372797.560856
#: Fixed value: the latitude up to which the geo commands take members.
GEO_LATITUDE = 85.05112878
GEO_UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
_NUMBER = r"\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*"
_POINT = rf"(?i)^\s*POINT\s*\({_NUMBER}\s{_NUMBER}\)\s*$".replace(r"\s*\s\s*", r"\s+")


def point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), _text(x), F.lit(" "), _text(y), F.lit(")"))


def _text(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def from_text(text: Column) -> Column:
    """ST_GEOMFROMTEXT of points and polygons: the text as it is kept, null for what is neither."""
    made = F.when(text.rlike(_POINT), point(x(text), y(text)))
    ring = F.transform(_ring(text), lambda p: F.concat(_text(p["x"]), F.lit(" "), _text(p["y"])))
    return made.when(text.rlike(r"(?i)^\s*POLYGON\s*\(\s*\("), F.concat(F.lit("POLYGON(("), F.array_join(ring, ", "), F.lit("))")))


def x(g: Column) -> Column:
    return F.regexp_extract(g, _POINT, 1).try_cast("double")


def y(g: Column) -> Column:
    return F.regexp_extract(g, _POINT, 2).try_cast("double")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(x(a) - x(b), 2) + F.pow(y(a) - y(b), 2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = GEO_SPHERE) -> Column:
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def distance_sphere(a: Column, b: Column) -> Column:
    return haversine(x(a), y(a), x(b), y(b), SPHERE)


def _ring(g: Column) -> Column:
    """The corners of a polygon's outer ring as an array of (x, y)."""
    inner = F.regexp_extract(g, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    corner = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(corner, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("double").alias("x"), F.get(p, F.lit(1)).try_cast("double").alias("y")))


def contains(a: Column, b: Column) -> Column:
    """A point contains itself; a polygon the points in it, by ray casting."""
    ring, px, py = _ring(a), x(b), y(b)
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, i + 1).alias("q")))
    crossed = F.filter(edges, lambda e: ((e["p"]["y"] > py) != (e["q"]["y"] > py)) & (px < (e["q"]["x"] - e["p"]["x"]) * (py - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"]))
    inside = F.size(crossed) % 2 == 1
    return F.when(a.rlike(r"(?i)^\s*POLYGON"), inside).otherwise((x(a) == px) & (y(a) == py))


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def intersects(a: Column, b: Column) -> Column:
    return (x(a) == x(b)) & (y(a) == y(b))


def srid(g: Column) -> Column:
    return F.when(g.isNotNull(), F.lit(0))


def _interleave(lon: Column, lat: Column) -> Column:
    """52 bits: 26 of each, longitude first in each pair."""
    a = F.least(F.floor((lon + 180.0) / 360.0 * 2**26), F.lit(2**26 - 1)).cast("long")
    b = F.least(F.floor((lat + 90.0) / 180.0 * 2**26), F.lit(2**26 - 1)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(26):
        out = out + F.shiftleft(F.shiftright(a, i).bitwiseAND(F.lit(1)), 2 * i + 1) + F.shiftleft(F.shiftright(b, i).bitwiseAND(F.lit(1)), 2 * i)
    return out


def geohash(lon: Column, lat: Column, digits: int = 10) -> Column:
    """Standard base-32 geohash text."""
    bits, alphabet = _interleave(lon, lat), "0123456789bcdefghjkmnpqrstuvwxyz"
    return F.concat(*[F.substring(F.lit(alphabet), (F.shiftright(bits, 52 - 5 * (i + 1)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(digits)])
