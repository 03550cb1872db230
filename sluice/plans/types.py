"""The three types of the language, and the names in scope."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from sluice.plans.errors import Code, QueryError
from sluice.plans.syntax import Leaf


class Type(Enum):
    INT64 = "bigint"
    FLOAT64 = "double"
    STRING = "string"


@dataclass(frozen=True)
class Column:
    """A column in scope: the name queries use, and its own name in the DataFrame, which no other has. raw: for an
    integer that stands for something else, what it is, so that conditions can ask the source's own column. wide: for a
    computed integer, the id of a decimal column that holds it beyond 64 bits too, if averages read that."""

    name: str
    id: str
    type: Type
    raw: Raw | None = None
    wide: str | None = None


@dataclass(frozen=True)
class Raw:
    """The column id of a date, timestamp or timestamp_ntz, counted from 1970 in days or microseconds; and, where rows
    come from files as they are, its name there."""

    id: str
    kind: str
    name: str

    def literal(self, value: int) -> SparkColumn | None:
        """The date or time that the integer stands for; None if there is none."""
        if self.kind == "date":
            return F.date_from_unix_date(F.lit(value)) if -(1 << 31) <= value < 1 << 31 else None
        moment = F.timestamp_micros(F.lit(value).cast("bigint"))
        return moment.cast("timestamp_ntz") if self.kind == "timestamp_ntz" else moment


class Scope(tuple[Column, ...]):
    def find(self, name: Leaf) -> Column:
        found = [c for c in self if c.name.lower() == name.text.lower()]
        if len(found) == 1:
            return found[0]
        raise QueryError(Code.AMBIGUOUS_COLUMN if found else Code.UNKNOWN_COLUMN, name.at)

    def repeats_a_name(self) -> bool:
        return len({c.name.lower() for c in self}) < len(self)
