"""The engine: queries as text, or stage by stage, to lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession

from sluice.functions.scalar import CHOICES, STRING_FUNCTIONS
from sluice.operators.relation import Relation
from sluice.operators.stages import AGGREGATION, RELATIONAL, Compiler
from sluice.plans.errors import run_errors
from sluice.plans.registry import Registry
from sluice.plans.syntax import Parser, parse
from sluice.sources import tables
from sluice.sources.tables import Catalog

STANDARD = Registry([*RELATIONAL, *AGGREGATION], [*CHOICES, *STRING_FUNCTIONS])


class Engine:
    """Runs queries over a catalog of tables.

    strict: tables with columns of types that the language lacks are refused, else those columns are left
    out. ordered: rows keep their places in the source, so that sorts are stable, groups come in first-seen
    order and LIMIT needs no ORDER BY; it costs a column and a sort where that matters. Without it, rows
    have an order only after ORDER BY. Integer overflow is an error only in ANSI mode, which is required.
    wide_averages: avg reads products, sums and differences of integers as they are, whether or not they fit
    64 bits; all else that reads such a column fails where they don't.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | dict | None = None, registry: Registry = STANDARD, strict: bool = True, ordered: bool = False, wide_averages: bool = False):
        if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
            raise ValueError("spark.sql.ansi.enabled must be true")
        self.spark, self.registry, self.strict, self.ordered, self.wide_averages = spark, registry, strict, ordered, wide_averages
        self.catalog = catalog if isinstance(catalog, Catalog) else Catalog(catalog)

    def register(self, name: str, frame: DataFrame) -> None:
        self.catalog.add(name, frame)

    def register_parquet(self, name: str, *paths: str) -> None:
        files = tables.ParquetFiles(self.spark, paths)
        files.frame()  # an error of the files comes now
        self.catalog.add(name, files)

    def register_values(self, name: str, columns: dict) -> None:
        self.catalog.add(name, tables.values(self.spark, columns))

    def table(self, name: str) -> Relation | None:
        found = self.catalog.find(name)
        return None if found is None else tables.relation(found, self.strict, self.ordered)

    def compile(self, query: str) -> Relation:
        """QueryError if the query can't be parsed or compiled. Nothing runs but, for count, min and max of a whole
        table of Parquet files, a look at the files' footers."""
        return Compiler(self).run(parse(query, self.registry))

    def sql(self, query: str) -> DataFrame:
        relation = self.compile(query)
        if relation.order:
            relation = Relation(relation.frame.orderBy(relation.order), relation.scope, relation.order)
        return relation.result()

    def rows(self, query: str) -> list[Row]:
        """The rows of a query, run now; a failure of the run is a RunError."""
        frame = self.sql(query)
        with run_errors():
            return frame.collect()

    def stream(self, frame: DataFrame, stages: str) -> DataFrame:
        """Stages such as "WHERE a > 1 |> EXTEND a + 1 AS b" over any DataFrame, a streaming one too, as far as
        Structured Streaming allows them in the output mode used."""
        return self.then(tables.relation(frame, self.strict), stages).result()

    def then(self, relation: Relation, stages: str) -> Relation:
        """The relation sent through more stages, written as in a query."""
        parser = Parser(stages, self.registry)
        parsed = [parser.stage(first=False)]
        while parser.current.text == "|>":
            parser.advance()
            parsed.append(parser.stage(first=False))
        parser.end()
        return Compiler(self, relation).run(parsed)
