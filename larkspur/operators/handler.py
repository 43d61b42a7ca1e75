"""HANDLER: a cursor over a table in the order of its key.

A read is a range scan behind (or before) the last key that was given, so nothing is held but that key, and a read of n rows
is a top-n of the table, not a sort of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class HandlerError(ValueError):
    """A read of a cursor that is closed, or in a direction that there is not."""


@dataclass
class Handler:
    """table: rows with a key column that is unique and not null."""

    table: DataFrame
    key: str
    at: object = None
    is_open: bool = True

    def read(self, where_to: str = "next", limit: int = 1, where: Column | None = None) -> list[Row]:
        """first, next, prev or last: up to ``limit`` rows (those of one read pass through the driver). PREV and LAST go
        backwards; a read that finds nothing leaves the cursor where it is."""
        if not self.is_open:
            raise HandlerError("the cursor is closed")
        if where_to not in ("first", "next", "prev", "last"):
            raise HandlerError(f"no such read: {where_to}")
        back = where_to in ("prev", "last")
        rows = self.table if where is None else self.table.where(where)
        if where_to in ("next", "prev") and self.at is not None:
            rows = rows.where(F.col(self.key) < F.lit(self.at) if back else F.col(self.key) > F.lit(self.at))
        elif where_to == "prev":
            return []
        found = rows.orderBy(F.col(self.key).desc() if back else F.col(self.key).asc()).limit(limit).collect()
        if found:
            self.at = found[-1][self.key]
        return found

    def close(self) -> None:
        self.is_open = False
