"""The language's aggregate functions."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from sluice.plans.types import Type

# What each reads.
READS = {
    "count": (Type.INT64,),
    "sum": (Type.INT64,),
    "avg": (Type.INT64,),
    "min": (Type.INT64, Type.STRING),
    "max": (Type.INT64, Type.STRING),
}


def result_type(name: str, read: Type) -> Type:
    return Type.FLOAT64 if name == "avg" else read if name in ("min", "max") else Type.INT64


def aggregate(name: str, x: SparkColumn | None, distinct: bool, wide: bool = False) -> SparkColumn:
    """NULL values don't count; sums overflow as an error; an average is the exact sum divided once. wide: an average
    reads a decimal."""
    if x is None:
        return F.count(F.lit(1))
    if name == "count":
        return F.count_distinct(x) if distinct else F.count(x)
    if name == "sum":
        return F.sum_distinct(x) if distinct else F.sum(x)
    if name == "avg":
        exact = x if wide else x.cast("decimal(20,0)")
        total, n = (F.sum_distinct(exact), F.count_distinct(x)) if distinct else (F.sum(exact), F.count(x))
        return F.when(n > 0, total.cast("double") / n)
    return F.min(x) if name == "min" else F.max(x)
