"""Registry of named queries: a Spark function and, where SQL can tell it, the DuckDB text of the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "q01_pricing_summary"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("relational", "functions", "tables", "system", "keyvalue", "statements", "commands", "routines", "ddl", "objects")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"larkspur.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
