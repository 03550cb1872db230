"""The language's stages, each a change of the relation so far."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.functions.aggregates import READS, aggregate, result_type
from sluice.operators.relation import Relation, fresh
from sluice.plans.conditions import ConditionCompiler
from sluice.plans.errors import Code, QueryError, Unsupported
from sluice.plans.expressions import ExpressionCompiler, wide
from sluice.plans.registry import StageRule
from sluice.plans.syntax import Call, Items, Leaf, Named, Node, SortKey, Stage, Unary
from sluice.plans.tokens import Kind
from sluice.plans.types import Column, Scope, Type

_INT32_MAX = (1 << 31) - 1
#: So many rows LIMIT and OFFSET leave to Spark, which gathers them from each task in one; and the rows of a file that
#: are counted as one block where they are more.
_TAKEN_MAX, _BLOCK_BITS = 1000, 16


class Compiler:
    """Compiles stages one after the other; relation is what the stages so far give."""

    def __init__(self, engine, relation: Relation | None = None):
        self.engine, self.relation = engine, relation

    @property
    def scope(self) -> Scope:
        return self.relation.scope

    def run(self, stages: list[Stage]) -> Relation:
        for stage in stages:
            stage.rule.compile(self, stage)
        return self.relation

    def value(self, node: Node, name: str | None, computed: dict) -> Column:
        """The column that node names, or a new one of that name, which is added to computed."""
        if isinstance(node, Leaf) and node.kind == Kind.IDENTIFIER and not node.is_name("null"):
            found = self.scope.find(node)
            return replace(found, name=name or found.name)
        if name is None:
            raise QueryError(Code.EXPECTED_NAME, node.span())
        step = ExpressionCompiler(self.scope, self.engine.registry).compile(node)
        id_, type_ = fresh(), step.type or Type.INT64
        computed[id_] = step.as_type(type_)
        if not self.engine.wide_averages or step.type != Type.INT64 or step.op not in ("+", "-", "*"):
            return Column(name, id_, type_)
        wide_id = fresh()
        computed[wide_id] = wide(step)
        return Column(name, id_, type_, wide=wide_id)


def _from(compiler: Compiler, stage: Stage) -> None:
    name = stage.parts[0]
    relation = compiler.engine.table(name.text)
    if relation is None:
        raise QueryError(Code.UNKNOWN_TABLE, name.at)
    if relation.scope.repeats_a_name():
        raise QueryError(Code.DUPLICATE_COLUMN, name.at)
    compiler.relation = relation


def _where(compiler: Compiler, stage: Stage) -> None:
    condition = ConditionCompiler(compiler.scope).compile(stage.parts[0])
    compiler.relation = replace(compiler.relation, frame=compiler.relation.frame.where(condition), files=None)


def _project(keep: bool):
    def compile_(compiler: Compiler, stage: Stage) -> None:
        computed: dict = {}
        scope = list(compiler.scope) if keep else []
        for item in stage.parts[0].items:
            value, name = (item.value, item.name.text) if isinstance(item, Named) else (item, None)
            scope.append(compiler.value(value, name, computed))
        compiler.relation = compiler.relation.computed(computed).with_scope(scope)

    return compile_


def _listed(names: list[Leaf]) -> None:
    """ListedTwice for a name that an earlier one repeats."""
    seen: set[str] = set()
    for name in names:
        if name.text.lower() in seen:
            raise QueryError(Code.LISTED_TWICE, name.at)
        seen.add(name.text.lower())


def _drop(compiler: Compiler, stage: Stage) -> None:
    names = list(stage.parts[0].items)
    scope = list(compiler.scope)
    for k, name in enumerate(names):
        _listed(names[: k + 1])
        left = [c for c in scope if c.name.lower() != name.text.lower()]
        if len(left) == len(scope):
            raise QueryError(Code.UNKNOWN_COLUMN, name.at)
        scope = left
    if not scope:
        raise QueryError(Code.NO_COLUMNS_LEFT, names[0].at)
    compiler.relation = compiler.relation.with_scope(scope)


def _in_place(renames: bool):
    def compile_(compiler: Compiler, stage: Stage) -> None:
        items, computed = stage.parts[0].items, {}
        targets = [item.value if renames else item.name for item in items]
        before, scope = compiler.scope, list(compiler.scope)
        for k, (item, target) in enumerate(zip(items, targets)):
            _listed(targets[: k + 1])
            found = before.find(target)
            at = before.index(found)
            if renames:
                scope[at] = replace(found, name=item.name.text)
            else:
                scope[at] = compiler.value(item.value, found.name, computed)
        compiler.relation = compiler.relation.computed(computed).with_scope(scope)

    return compile_


def _order_by(compiler: Compiler, stage: Stage) -> None:
    keys = []
    for key in stage.parts[0].items:
        assert isinstance(key, SortKey)
        if not (isinstance(key.value, Leaf) and key.value.kind == Kind.IDENTIFIER):
            raise QueryError.unsupported(Unsupported.ORDER_BY, key.span())
        column = F.col(compiler.scope.find(key.value).id)
        keys.append(column.desc_nulls_last() if key.descending else column.asc_nulls_first())
    relation = compiler.relation
    if relation.order:
        keys.append(F.col(relation.order).asc())
    frame = relation.frame.orderBy(*keys)
    if relation.order:  # later stages see the rows in this order
        frame = frame.drop(relation.order).withColumn(relation.order, F.monotonically_increasing_id())
    compiler.relation = replace(relation, frame=frame)


def _count(node: Node) -> int:
    if not (isinstance(node, Leaf) and node.kind == Kind.INTEGER):
        raise QueryError.unsupported(Unsupported.LIMIT, node.span())
    if int(node.text) >= 1 << 64:
        raise QueryError(Code.NUMBER_TOO_LARGE, node.at)
    return int(node.text)


def _ranked_between(frame: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """The rows from the first to the last, from 0 in the order of their places in files. Rows are counted by blocks of
    files, and places ranked in the two blocks where those two rows stand; all rows are then held against those two
    places where they are, so that none is moved."""
    place = F.col(order)
    block = F.struct(place["path"].alias("path"), place["file"].alias("file"), F.shiftright(place["row"], _BLOCK_BITS).alias("rows"))
    counted = frame.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    begins = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ends = counted.select("block", "n", begins.alias("begins")).where(" OR ".join(f"begins <= {k} AND begins + n > {k}" for k in (first, last)))
    ranked = frame.select(place.alias("place"), block.alias("block")).join(F.broadcast(ends.select("block", "begins")), "block")
    rank = F.col("begins") + F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    places = ranked.select("place", rank.alias("rank")).agg(*(F.min(F.when(F.col("rank") == k, F.col("place"))).alias(name) for k, name in ((first, "least"), (last, "most"))))
    kept = (place >= F.col("least")) & (F.col("most").isNull() | (place <= F.col("most")))  # most is NULL if fewer rows follow
    return frame.join(F.broadcast(places), kept).select(*frame.columns)


def _limit(compiler: Compiler, stage: Stage) -> None:
    """Spark counts rows in 32 bits here; larger numbers are refused rather than misread."""
    count, offsets = _count(stage.parts[0]), stage.parts[1].items
    if len(offsets) > 1:
        raise QueryError.unsupported(Unsupported.LIMIT, offsets[1].span())
    offset = _count(offsets[0]) if offsets else 0
    for node, n in ((stage.parts[0], count), *zip(offsets, (offset,))):
        if n > _INT32_MAX:
            raise QueryError.unsupported(Unsupported.LIMIT, node.span())
    frame, order = compiler.relation.frame, compiler.relation.order
    if count and count + offset > _TAKEN_MAX and order and isinstance(frame.schema[order].dataType, StructType):
        frame = _ranked_between(frame, order, offset, offset + count - 1)
    else:
        if order:
            frame = frame.orderBy(order)
        if offset:
            frame = frame.offset(offset)
        frame = frame.limit(count)
    compiler.relation = replace(compiler.relation, frame=frame, files=None)


def _aggregate(compiler: Compiler, stage: Stage) -> None:
    scope: list[Column] = []
    keys: list[str] = []
    for item in stage.parts[1].items:
        key, alias = (item.value, item.name.text) if isinstance(item, Named) else (item, None)
        if not (isinstance(key, Leaf) and key.kind == Kind.IDENTIFIER):
            raise QueryError.unsupported(Unsupported.GROUP_KEY, key.span())
        column = compiler.scope.find(key)
        if column.type not in (Type.INT64, Type.STRING):
            raise QueryError.unsupported(Unsupported.GROUP_KEY, key.at)
        keys.append(column.id)
        scope.append(replace(column, name=alias or column.name, raw=None, wide=None))
    columns, plain = [], []
    for item in stage.parts[0].items:
        call, alias = (item.value, item.name.text) if isinstance(item, Named) else (item, None)
        name, column, distinct, written = _aggregate_call(compiler, call)
        type_ = result_type(name, column.type) if column else Type.INT64
        id_ = fresh()
        distinct = distinct and name not in ("min", "max")
        read = column and F.col(column.wide if name == "avg" and column.wide else column.id)
        columns.append(aggregate(name, read, distinct, bool(column and column.wide)).cast(type_.value).alias(id_))
        plain.append((id_, name if not distinct else None, column))
        scope.append(Column(alias or written, id_, type_))
    relation = compiler.relation
    if not keys and relation.files and (known := relation.files.summary(plain)):
        compiler.relation = Relation(known, Scope(scope))
        return
    order = relation.order and fresh()
    if order:
        columns.append(F.min(relation.order).alias(order))
    frame = relation.frame.groupBy(*dict.fromkeys(keys)).agg(*columns) if keys else relation.frame.agg(*columns)
    compiler.relation = Relation(frame, Scope(scope), order or None)


def _aggregate_call(compiler: Compiler, call: Node) -> tuple[str, Column | None, bool, str]:
    """The function, its column (None for count(*)), whether of distinct values, and the name it goes by."""
    wrong = QueryError.unsupported(Unsupported.AGGREGATE, call.span())
    if not isinstance(call, Call) or len(call.arguments) != 1:
        raise wrong
    name = call.name.text.lower()
    if name not in READS:
        raise QueryError(Code.UNKNOWN_FUNCTION, call.name.at)
    (argument,) = call.arguments
    distinct = isinstance(argument, Unary) and argument.operator == "distinct"
    if distinct:
        argument = argument.operand
    if not isinstance(argument, Leaf):
        raise wrong
    if argument.kind == Kind.STAR and name == "count" and not distinct:
        return name, None, False, "count(*)"
    if argument.kind != Kind.IDENTIFIER:
        raise wrong
    column = compiler.scope.find(argument)
    if column.type not in READS[name]:
        raise QueryError.unsupported(Unsupported.AGGREGATE_TYPE, call.span())
    return name, column, distinct, f"{name}({'DISTINCT ' if distinct else ''}{argument.text})"


RELATIONAL = (
    StageRule("FROM", lambda p: (p.name(),), _from, source=True),
    StageRule("WHERE", lambda p: (p.expression(),), _where),
    StageRule("SELECT", lambda p: (p.items(p.aliased),), _project(keep=False)),
    StageRule("EXTEND", lambda p: (p.items(p.aliased),), _project(keep=True)),
    StageRule("DROP", lambda p: (p.items(p.name),), _drop),
    StageRule("RENAME", lambda p: (p.items(p.renamed),), _in_place(renames=True)),
    StageRule("SET", lambda p: (p.items(p.assigned),), _in_place(renames=False)),
    StageRule("LIMIT", lambda p: (p.expression(), p.items(p.expression) if p.words("offset", optional=True) else Items(())), _limit),
)
AGGREGATION = (
    StageRule("AGGREGATE", lambda p: (p.items(p.aliased), p.items(p.aliased) if p.words("group", "by", optional=True) else Items(())), _aggregate),
    StageRule("ORDER", lambda p: (p.items(p.ordered),) if p.words("by") else (), _order_by),
)
