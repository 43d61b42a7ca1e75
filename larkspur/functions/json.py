"""JSON functions over JSON text. Documents stay text; paths are literals such as ``$.a.b[0]``.

Reading uses built-in expressions. Changing a document at a path and merging documents need the document as a value;
those run as Arrow functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.strings import _c
from larkspur.session import send_package

_STEP = re.compile(r"\.\"([^\"]+)\"|\.([A-Za-z0-9_]+)|\[(\d+)\]")


def extract(doc: Column, path: str) -> Column:
    """Strings come back without quotes."""
    return F.get_json_object(doc, path)


def unquote(s: Column) -> Column:
    return F.when(s.rlike('(?s)^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v")).otherwise(s)


def valid(s: Column) -> Column:
    return F.when(s.isNull(), 0).otherwise(F.try_parse_json(s).isNotNull().cast("int"))


def keys(doc: Column) -> Column:
    return F.to_json(F.json_object_keys(doc))


def length(doc: Column) -> Column:
    """Members of an object, elements of an array, 1 for a scalar."""
    return F.when(valid(doc) == 1, F.coalesce(F.json_array_length(doc), F.when(F.json_object_keys(doc).isNotNull(), F.size(F.json_object_keys(doc))), F.lit(1)))


def type_(doc: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(doc))
    return (
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "STRING", "STRING")
        .when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL").when(kind.isNotNull(), "NUMBER")
    )


def contains_path(doc: Column, mode: str, *paths: str) -> Column:
    found = [F.get_json_object(doc, p).isNotNull() for p in paths]
    out = found[0]
    for x in found[1:]:
        out = (out & x) if mode == "all" else (out | x)
    return F.when(doc.isNull(), None).otherwise(out.cast("int"))


def piece(x, kind: str) -> Column:
    """A value of a column type as JSON text."""
    x = _c(x)
    if kind == "string":
        text = F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")
        return F.coalesce(F.when(x.isNotNull(), text), F.lit("null"))
    return F.coalesce(x.cast("string"), F.lit("null"))


def array(*items: tuple) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[piece(x, kind) for x, kind in items]), F.lit("]"))


def object_(*members: tuple) -> Column:
    """members: (key, value, type of value)."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(piece(F.lit(k) if isinstance(k, str) else k, "string"), F.lit(":"), piece(v, kind)) for k, v, kind in members]), F.lit("}"))


def _steps(path: str) -> list:
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path}")
    return [int(m[3]) if m[3] is not None else m[1] or m[2] for m in _STEP.finditer(path, 1)]


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _per_row(change: Callable, kind: str, *docs: Column) -> Column:
    """A null or malformed document gives null."""
    arrow = {"string": pa.string(), "int": pa.int32()}[kind]

    def run(*columns):
        out = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                out.append(None if None in row else change(*map(json.loads, row)))
            except (ValueError, TypeError):
                out.append(None)
        return pa.array(out, arrow)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    send_package()
    return F.arrow_udf(one if len(docs) == 1 else two, kind)(*docs)


def _put(doc, steps: list, value, create: bool, replace: bool):
    if not steps:
        return value if replace else doc
    at = doc
    for s in steps[:-1]:
        if isinstance(at, dict) and s in at:
            at = at[s]
        elif isinstance(at, list) and isinstance(s, int) and s < len(at):
            at = at[s]
        else:
            return doc
    last = steps[-1]
    if isinstance(at, dict) and isinstance(last, str):
        if (last in at and replace) or (last not in at and create):
            at[last] = value
    elif isinstance(at, list) and isinstance(last, int):
        if last < len(at):
            if replace:
                at[last] = value
        elif create:
            at.append(value)
    return doc


def _change(doc: Column, changes: tuple, create: bool, replace: bool) -> Column:
    parsed = [(_steps(p), v) for p, v in changes]

    def run(d):
        for steps, v in parsed:
            d = _put(d, steps, v, create, replace)
        return _dump(d)

    return _per_row(run, "string", doc)


def set_(doc: Column, *changes: tuple) -> Column:
    """changes: (path, value)."""
    return _change(doc, changes, True, True)


def insert(doc: Column, *changes: tuple) -> Column:
    return _change(doc, changes, True, False)


def replace(doc: Column, *changes: tuple) -> Column:
    return _change(doc, changes, False, True)


def remove(doc: Column, *paths: str) -> Column:
    parsed = [_steps(p) for p in paths]

    def run(d):
        for steps in parsed:
            at = d
            for s in steps[:-1]:
                at = at[s] if (isinstance(at, dict) and s in at) or (isinstance(at, list) and isinstance(s, int) and s < len(at)) else None
            if steps and isinstance(at, dict):
                at.pop(steps[-1], None)
            elif steps and isinstance(at, list) and isinstance(steps[-1], int) and steps[-1] < len(at):
                del at[steps[-1]]
        return _dump(d)

    return _per_row(run, "string", doc)


def _contains(doc, target) -> bool:
    if isinstance(doc, dict):
        return isinstance(target, dict) and all(k in doc and _contains(doc[k], v) for k, v in target.items())
    if isinstance(doc, list):
        return all(_contains(doc, t) for t in target) if isinstance(target, list) else any(_contains(d, target) for d in doc)
    return type(doc) is type(target) and doc == target or (isinstance(doc, (int, float)) and isinstance(target, (int, float)) and not isinstance(doc, bool) and not isinstance(target, bool) and doc == target)


def contains(doc: Column, target: Column) -> Column:
    return _per_row(lambda d, t: int(_contains(d, t)), "int", doc, target)


def _patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def merge_patch(a: Column, b: Column) -> Column:
    """RFC 7396."""
    return _per_row(lambda x, y: _dump(_patch(x, y)), "string", a, b)


def _preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: _preserve(a[k], v) if k in a else v for k, v in b.items()}}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def merge_preserve(a: Column, b: Column) -> Column:
    return _per_row(lambda x, y: _dump(_preserve(x, y)), "string", a, b)


def search(doc: Column, mode: str, pattern: str) -> Column:
    """Path, or with "all" an array of paths, of the strings that are like the pattern, without regard to case."""
    like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), re.I | re.S)

    def walk(x, path):
        if isinstance(x, str):
            if like.fullmatch(x):
                yield path
        elif isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")

    def run(d):
        found = list(walk(d, "$"))
        return None if not found else _dump(found[0] if mode == "one" or len(found) == 1 else found)

    return _per_row(run, "string", doc)


def arrayagg(value: Column, kind: str, order: Column) -> Column:
    """Keeps nulls; ordered by ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), piece(value, kind).alias("p"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["p"]), ","), F.lit("]"))


def objectagg(key: Column, value: Column, kind: str) -> Column:
    """The last value of a key wins, in order of values; members in order of keys."""
    rows = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), piece(value, kind).alias("p"))))
    last = F.filter(F.transform(rows, lambda r, i: F.struct(r["k"].alias("k"), r["p"].alias("p"), F.get(rows, i + 1)["k"].alias("n"))), lambda r: r["n"].isNull() | (r["n"] != r["k"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda r: F.concat(piece(r["k"], "string"), F.lit(":"), r["p"])), ","), F.lit("}"))
