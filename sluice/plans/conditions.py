"""Conditions of WHERE: comparisons of a column with a literal, LIKE, IN and null tests, combined.

They become one Spark predicate, so that Catalyst can push its parts to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from sluice.plans.errors import Code, QueryError, Unsupported
from sluice.plans.expressions import COMPARISONS, compared, exact_double, integer, like
from sluice.plans.syntax import Binary, Items, Leaf, Node, Unary
from sluice.plans.tokens import Kind
from sluice.plans.types import Column, Scope, Type

# Limits of a condition.
PARTS_MAX, VALUES_MAX = 64, 65_536
_SWAPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!="}


class ConditionCompiler:
    def __init__(self, scope: Scope):
        self.scope, self.parts, self.values = scope, 0, 0

    def count(self, node: Node) -> None:
        self.parts += 1
        if self.parts > PARTS_MAX:
            raise QueryError(Code.CONDITION_TOO_LARGE, node.span())

    def compile(self, node: Node) -> SparkColumn:
        if isinstance(node, Unary) and node.operator == "not":
            out = ~self.compile(node.operand)
        elif isinstance(node, Unary) and node.operator in ("null", "not null"):
            named = self.column(node.operand, node.operand)
            column = F.col(named.raw.id if named.raw else named.id)
            if node.operator == "not null":
                self.count(node.operand)
            out = column.isNull() if node.operator == "null" else column.isNotNull()
        elif isinstance(node, Binary) and node.operator in ("and", "or"):
            left, right = self.compile(node.left), self.compile(node.right)
            out = left & right if node.operator == "and" else left | right
        elif isinstance(node, Binary) and node.operator == "in":
            out = self.membership(node)
        elif isinstance(node, Binary) and node.operator == "like":
            out = self.like(node)
        elif isinstance(node, Binary) and node.operator in COMPARISONS:
            out = self.comparison(node)
        else:
            raise QueryError.unsupported(Unsupported.WHERE, node.span())
        self.count(node)
        return out

    def column(self, node: Node, about: Node):
        if not (isinstance(node, Leaf) and node.kind == Kind.IDENTIFIER):
            raise QueryError.unsupported(Unsupported.WHERE, about.span())
        return self.scope.find(node)

    def comparison(self, node: Binary) -> SparkColumn:
        name, literal, operator = node.left, node.right, node.operator
        if not (isinstance(name, Leaf) and name.kind == Kind.IDENTIFIER):
            name, literal, operator = literal, name, _SWAPPED[operator]
        column = self.column(name, node)
        if column.type == Type.STRING and isinstance(literal, Leaf) and literal.kind == Kind.STRING:
            return compared(operator, F.col(column.id), F.lit(literal.text))
        return self.asked(column, [self.number(literal, column.type)], lambda x, values: compared(operator, x, values[0]))

    @staticmethod
    def asked(column: Column, values: list, test: Callable[[SparkColumn, list], SparkColumn]) -> SparkColumn:
        """The test, of the source's own date or time if that is what the integers stand for: the scan can take it."""
        moments = [column.raw.literal(v) for v in values] if column.raw else []
        if moments and all(m is not None for m in moments):
            return test(F.col(column.raw.id), moments)
        return test(F.col(column.id), [F.lit(v) for v in values])

    def number(self, node: Node, type_: Type, negative: bool = False) -> int | float:
        if isinstance(node, Unary) and node.operator == "negate":
            return self.number(node.operand, type_, not negative)
        if not isinstance(node, Leaf) or node.kind not in (Kind.INTEGER, Kind.FLOAT):
            raise QueryError.unsupported(Unsupported.WHERE, node.span())
        if node.kind == Kind.FLOAT:
            raise QueryError.unsupported(Unsupported.DECIMAL, node.at)
        value = integer(node, negative)
        if type_ == Type.STRING:
            raise QueryError.unsupported(Unsupported.WHERE, node.at)
        if type_ == Type.FLOAT64:
            if (double := exact_double(value)) is None:
                raise QueryError.unsupported(Unsupported.NUMBER_TYPE, node.at)
            return double
        return value

    def like(self, node: Binary) -> SparkColumn:
        if not (isinstance(node.right, Leaf) and node.right.kind == Kind.STRING):
            raise QueryError.unsupported(Unsupported.WHERE, node.span())
        column = self.column(node.left, node)
        if column.type != Type.STRING:
            raise QueryError.unsupported(Unsupported.WHERE, node.span())
        return like(F.col(column.id), node.right.text)

    def membership(self, node: Binary) -> SparkColumn:
        column, items = self.column(node.left, node), node.right
        assert isinstance(items, Items)
        self.values += len(items.items)
        if self.values > VALUES_MAX:
            raise QueryError(Code.CONDITION_TOO_LARGE, items.span())
        values: list[int | str] = []
        for item in items.items:
            if column.type == Type.INT64:
                values.append(self.number(item, Type.INT64))
            elif column.type == Type.STRING and isinstance(item, Leaf) and item.kind == Kind.STRING:
                values.append(item.text)
            else:
                raise QueryError.unsupported(Unsupported.WHERE, item.span())
        return self.asked(column, values, lambda x, them: x.isin(them)) if column.raw else F.col(column.id).isin(values)
