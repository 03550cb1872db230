"""The language's scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from sluice.plans.expressions import ExpressionCompiler, Step
from sluice.plans.registry import FunctionRule
from sluice.plans.syntax import Call
from sluice.plans.types import Type


def function(name: str, takes: tuple[Type, ...], gives: Type, build: Callable[..., SparkColumn]) -> FunctionRule:
    """A rule for a function of columns: build gets them and returns one, by built-ins or a vectorized UDF.
    It isn't asked where an argument is NULL; the result is NULL then."""
    return FunctionRule(name, lambda compiler, node: compiler.function(node, takes, gives, build))


def _iif(compiler: ExpressionCompiler, node: Call) -> Step:
    condition, value, otherwise = compiler.arguments(node, 3, 3)
    return compiler.made(node, Step("case", (condition, value), otherwise=otherwise), 2)


def _coalesce(most: int | None) -> Callable[[ExpressionCompiler, Call], Step]:
    def compile_(compiler: ExpressionCompiler, node: Call) -> Step:
        of = compiler.arguments(node, 2, most)
        return compiler.made(node, Step("coalesce", of), len(of))

    return compile_


def _length(s: SparkColumn) -> SparkColumn:
    """Characters before the first NUL."""
    return F.char_length(F.substring_index(s, "\0", 1))


CHOICES = (
    FunctionRule("iif", _iif),
    FunctionRule("ifnull", _coalesce(2)),
    FunctionRule("coalesce", _coalesce(None)),
)
STRING_FUNCTIONS = (
    function("length", (Type.STRING,), Type.INT64, _length),
    function("octet_length", (Type.STRING,), Type.INT64, F.octet_length),
)
