"""Stored procedures and triggers.

A procedure's text is kept in a registry; CALL turns it into a Spark SQL script, whose control flow (IF, CASE, WHILE,
REPEAT, LOOP, FOR, LEAVE, ITERATE, nested blocks, EXIT handlers) Spark runs. What Spark's scripts lack is translated:
parameters become variables, SIGNAL and RESIGNAL an error that handlers of their state catch. A cursor is a FOR loop.

Triggers are functions of old and new rows as DataFrames, for all changed rows at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import dml

_HEAD = re.compile(r"(?is)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+(\w+)\s*\((.*?)\)\s*(BEGIN\b.*END)\s*;?\s*$")
_SIGNAL = re.compile(r"(?is)\b(?:RE)?SIGNAL(?:\s+SQLSTATE\s+(?:VALUE\s+)?'(\w{5})')?(?:\s+SET\s+MESSAGE_TEXT\s*=\s*('(?:[^']|'')*'))?")
#: The state that an error raised within a script has.
_RAISED = "P0001"


class RoutineError(ValueError):
    """A routine that is not there, or that is not called as it was made."""


@dataclass(frozen=True)
class Parameter:
    name: str
    mode: str
    kind: str


@dataclass(frozen=True)
class Procedure:
    name: str
    parameters: tuple[Parameter, ...]
    body: str


def parse_procedure(text: str) -> Procedure:
    m = _HEAD.match(text)
    if not m:
        raise RoutineError("not a procedure")
    parameters = []
    for part in re.split(r",(?![^(]*\))", m[2]) if m[2].strip() else []:
        p = re.match(r"(?is)^\s*(?:(INOUT|IN|OUT)\s+)?(\w+)\s+(.+?)\s*$", part)
        if not p:
            raise RoutineError(f"not a parameter: {part}")
        parameters.append(Parameter(p[2], (p[1] or "IN").upper(), p[3]))
    return Procedure(m[1], tuple(parameters), m[3])


def _signals(body: str) -> str:
    body = re.sub(rf"(?is)HANDLER\s+FOR\s+SQLSTATE\s+(?:VALUE\s+)?'45\d{{3}}'", f"HANDLER FOR SQLSTATE '{_RAISED}'", body)
    return _SIGNAL.sub(lambda m: f"SELECT raise_error({m[2] or repr('unhandled condition ' + (m[1] or ''))})", body)


def _script(p: Procedure, arguments: list[object]) -> str:
    """The call as a script: parameters become variables around the body, whose OUT and INOUT values are the result."""
    if len(arguments) != len(p.parameters):
        raise RoutineError(f"{p.name} takes {len(p.parameters)} arguments")
    declared = [f"DECLARE {x.name} {x.kind} DEFAULT {'NULL' if x.mode == 'OUT' or a is None else _literal(a)};" for x, a in zip(p.parameters, arguments, strict=True)]
    out = [x.name for x in p.parameters if x.mode != "IN"]
    body = _signals(p.body)
    return f"BEGIN {' '.join(declared)} {body}; {'SELECT ' + ', '.join(f'{x} AS {x}' for x in out) + ';' if out else ''} END"


def _literal(v: object) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v)


@dataclass
class Routines:
    """The procedures of a session."""

    spark: SparkSession
    held: dict[str, Procedure] = field(default_factory=dict)

    def create(self, text: str) -> Procedure:
        p = parse_procedure(text)
        replaces = re.match(r"(?is)^\s*CREATE\s+OR\s+REPLACE", text)
        if p.name.lower() in self.held and not replaces:
            raise RoutineError(f"{p.name} is there already")
        self.held[p.name.lower()] = p
        return p

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.held.pop(name.lower(), None) is None and not if_exists:
            raise RoutineError(f"no procedure {name}")

    def call(self, name: str, *arguments: object) -> DataFrame:
        """One row of the OUT and INOUT parameters, or what the procedure selects last."""
        if name.lower() not in self.held:
            raise RoutineError(f"no procedure {name}")
        return self.spark.sql(_script(self.held[name.lower()], list(arguments)))

    def show_create(self, name: str) -> DataFrame:
        """SHOW CREATE PROCEDURE: (procedure, create_procedure), a text that creates it again."""
        if name.lower() not in self.held:
            raise RoutineError(f"no procedure {name}")
        p = self.held[name.lower()]
        text = f"CREATE PROCEDURE {p.name}({', '.join(f'{x.mode} {x.name} {x.kind}' for x in p.parameters)}) {p.body}"
        return self.spark.createDataFrame([(p.name, text)], "procedure string, create_procedure string")

    def show(self) -> DataFrame:
        """SHOW PROCEDURE STATUS and information_schema.routines and parameters in one."""
        rows = [(p.name, "PROCEDURE", i, x.name, x.mode, x.kind) for p in self.held.values() for i, x in enumerate(p.parameters, 1)]
        rows += [(p.name, "PROCEDURE", 0, None, None, None) for p in self.held.values() if not p.parameters]
        return self.spark.createDataFrame(rows, "routine_name string, routine_type string, ordinal_position int, parameter_name string, parameter_mode string, data_type string")


Trigger = Callable[[DataFrame], DataFrame]


@dataclass
class Triggers:
    """Triggers by time and event. A BEFORE trigger maps the new rows (with ``old_`` columns on update); an AFTER trigger makes
    rows for its log."""

    held: dict[tuple[str, str], list[tuple[str, Trigger]]] = field(default_factory=dict)

    def create(self, name: str, time: str, event: str, action: Trigger) -> None:
        if time not in ("before", "after") or event not in ("insert", "update", "delete"):
            raise RoutineError(f"no such time or event: {time} {event}")
        if any(n == name for actions in self.held.values() for n, _ in actions):
            raise RoutineError(f"{name} is there already")
        self.held.setdefault((time, event), []).append((name, action))

    def drop(self, name: str) -> None:
        for key, actions in self.held.items():
            self.held[key] = [(n, a) for n, a in actions if n != name]

    def show(self, spark: SparkSession) -> DataFrame:
        """SHOW TRIGGERS: (trigger, event, timing) in the order in which those of one time and event act."""
        rows = [(name, event.upper(), time.upper()) for (time, event), actions in self.held.items() for name, _ in actions]
        return spark.createDataFrame(rows, "trigger string, event string, timing string")

    def _before(self, event: str, rows: DataFrame) -> DataFrame:
        for _, action in self.held.get(("before", event), []):
            rows = action(rows)
        return rows

    def _after(self, event: str, rows: DataFrame) -> list[DataFrame]:
        return [action(rows) for _, action in self.held.get(("after", event), [])]

    def insert(self, table: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        new = self._before("insert", rows)
        return dml.insert(table, new), self._after("insert", new)

    def update(self, table: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, list[DataFrame]]:
        hit = F.coalesce(where, F.lit(False))
        old = [F.col(c).alias(f"old_{c}") for c in table.columns]
        new = self._before("update", table.where(hit).select(*[values.get(c, F.col(c)).alias(c) for c in table.columns], *old))
        return table.where(~hit).unionByName(new.select(*table.columns)), self._after("update", new)

    def delete(self, table: DataFrame, where: Column) -> tuple[DataFrame, list[DataFrame]]:
        gone = self._before("delete", table.where(F.coalesce(where, F.lit(False))))
        return dml.delete(table, where), self._after("delete", gone)
