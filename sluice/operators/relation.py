"""A relation: a lazy DataFrame, and which of its columns queries see by which names."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.errors import Span
from sluice.plans.syntax import Leaf
from sluice.plans.tokens import Kind
from sluice.plans.types import Column, Scope, Type

_numbers = itertools.count()


def fresh() -> str:
    return f"_c{next(_numbers)}"


class Files(Protocol):
    """A source that can answer aggregates of all its rows without reading them."""

    def summary(self, wanted: list[tuple[str, str | None, Column | None]]) -> DataFrame | None:
        """For each (id, count, min or max, its column) a column id of one row; None if that isn't known."""


@dataclass(frozen=True)
class Relation:
    """frame has a column of a unique name for each id in scope, and the order column, if there is one."""

    frame: DataFrame
    scope: Scope
    order: str | None = None  # rows' place in the source, kept for stable sorts and first-seen groups
    files: Files | None = None  # whose rows these are, all of them

    def ids(self) -> list[str]:
        beside = [c.raw.id for c in self.scope if c.raw] + [c.wide for c in self.scope if c.wide]
        return [*dict.fromkeys([*(c.id for c in self.scope), *beside]), *([self.order] if self.order else [])]

    def with_scope(self, scope) -> Relation:
        return replace(self, scope=Scope(scope))

    def computed(self, columns: dict[str, SparkColumn]) -> Relation:
        """With columns added, all computed from those before."""
        return replace(self, frame=self.frame.select("*", *(c.alias(k) for k, c in columns.items()))) if columns else self

    def result(self) -> DataFrame:
        """The columns in scope under their names, which may repeat."""
        return self.frame.select(*(F.col(c.id) for c in self.scope)).toDF(*(c.name for c in self.scope))

    def join_n1(self, build: Relation, probe_key: str, build_key: str, columns: list[str] | None = None, trust_unique: bool = False) -> Relation:
        """Rows of this relation that have a partner, each with the columns of its one partner in build.

        Keys are integer columns; NULL has no partner. build_key must be unique: a key that build has twice fails
        the query when it runs, unless trust_unique leaves out that test, an aggregation of build by its key. A
        shuffled join needs that partitioning anyway. Whether build is broadcast or both sides are shuffled is left
        to Spark, which knows their sizes.
        """
        left, right = self.scope.find(named(probe_key)), build.scope.find(named(build_key))
        if left.type != Type.INT64 or right.type != Type.INT64:
            raise TypeError("join keys are integers")
        kept = [c for c in build.scope if columns is None or c.name.lower() in {x.lower() for x in columns}]
        if columns is not None and len(kept) < len({x.lower() for x in columns}):
            raise KeyError(f"build has no such column: {columns}")
        ids = {c.id: fresh() for c in kept}
        key = fresh()
        side = build.frame.select(F.col(right.id).alias(key), *(F.col(k).alias(v) for k, v in ids.items()))
        if not trust_unique:
            several = F.raise_error(F.lit(f"the join's key {build_key} isn't unique")).cast("bigint")
            counted = side.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.first(v).alias(v) for v in ids.values()))
            side = counted.select(F.when(F.col("n") == 1, F.col(key)).otherwise(several).alias(key), *ids.values())
        joined = self.frame.join(side, self.frame[left.id] == side[key], "inner").select(*self.ids(), *ids.values())
        return Relation(joined, Scope([*self.scope, *(Column(c.name, ids[c.id], c.type) for c in kept)]), self.order)


def named(text: str) -> Leaf:
    return Leaf(Kind.IDENTIFIER, text, Span(0, len(text)))
