"""Tables: DataFrames and Parquet files as relations of the language's three types."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.relation import Relation, fresh
from sluice.plans.types import Column, Raw, Scope, Type


class UnsupportedTable(ValueError):
    """A table that has a column of no type of the language."""


def _utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise UnsupportedTable("timestamps without a zone are read as UTC: set spark.sql.session.timeZone to UTC")


def normalized(column: SparkColumn, kind: T.DataType, spark: SparkSession) -> tuple[SparkColumn, Type] | None:
    """The column in the language's types, or None: integers widen; dates are days and timestamps
    microseconds since 1970; bytes are text, whether or not they are UTF-8."""
    if isinstance(kind, T.LongType):
        return column, Type.INT64
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint"), Type.INT64
    if isinstance(kind, T.DoubleType):
        return column, Type.FLOAT64
    if isinstance(kind, T.FloatType):
        return column.cast("double"), Type.FLOAT64
    if type(kind) is T.StringType or isinstance(kind, (T.VarcharType, T.CharType)):
        return column, Type.STRING
    if isinstance(kind, T.BinaryType):
        return column.cast("string"), Type.STRING
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint"), Type.INT64
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), Type.INT64
    if isinstance(kind, T.TimestampNTZType):
        _utc(spark)
        return F.unix_micros(column.cast("timestamp")), Type.INT64
    return None


_RAW = {T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz"}


def relation(source: DataFrame | ParquetFiles, strict: bool = True, ordered: bool = False) -> Relation:
    """source as a relation. strict: a column of another type is an error; else it is left out. ordered: with the rows'
    places: in files by path as listed, file name and row; of other DataFrames as Spark numbers their partitions."""
    order = fresh() if ordered else None
    if isinstance(source, ParquetFiles):
        frame, plain = source.numbered(order) if order else source.frame(), source.frame()
    else:
        frame, plain = source.withColumn(order, F.monotonically_increasing_id()) if order else source, source
    spark = plain.sparkSession
    ids = [fresh() for _ in plain.columns]  # at once, as names may repeat, ignoring case
    renamed = frame.toDF(*ids, *([order] if order else []))
    scope, columns = [], []
    for id_, f in zip(ids, plain.schema.fields):
        made = normalized(F.col(id_), f.dataType, spark)
        if made is not None:
            kind = _RAW.get(type(f.dataType))
            raw = Raw(fresh() if kind else id_, kind or "", f.name)
            columns += [made[0].alias(id_), *([F.col(id_).alias(raw.id)] if kind else [])]
            scope.append(Column(f.name, id_, made[1], raw if kind else None))
        elif strict:
            raise UnsupportedTable(f"column {f.name} is of type {f.dataType.simpleString()}")
    if not scope:
        raise UnsupportedTable("no column can be read")
    files = source.known({c.id: f.name for c, f in _pairs(scope, ids, plain)}) if isinstance(source, ParquetFiles) else None
    return Relation(renamed.select(*columns, *([order] if order else [])), Scope(scope), order, files)


def _pairs(scope: list[Column], ids: list[str], plain: DataFrame):
    by_id = dict(zip(ids, plain.schema.fields))
    return [(c, by_id[c.id]) for c in scope]


class ParquetFiles:
    """Parquet files or folders as one table, in the order listed. All must have the same columns: names, order and
    types, as far as one footer of each path tells."""

    def __init__(self, spark: SparkSession, paths: Sequence[str], summaries: bool = True):
        self.spark, self.paths, self.summaries = spark, tuple(paths), summaries
        self._frame: DataFrame | None = None
        self._footers: list[DataFrame] = []
        self.names: dict[str, str] = {}

    def frame(self) -> DataFrame:
        if self._frame is None:
            first = self.spark.read.parquet(self.paths[0])
            shape = [(f.name, f.dataType) for f in first.schema.fields]
            for path in self.paths[1:]:
                if [(f.name, f.dataType) for f in self.spark.read.parquet(path).schema.fields] != shape:
                    raise UnsupportedTable(f"{path} has other columns than {self.paths[0]}")
            self._frame = first if len(self.paths) == 1 else self.spark.read.schema(first.schema).parquet(*self.paths)
        return self._frame

    def numbered(self, order: str) -> DataFrame:
        """The rows with their place: a row's number in its file, whichever task reads it."""
        schema = self.frame().schema
        parts = []
        for k, path in enumerate(self.paths):
            place = F.struct(F.lit(k).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            parts.append(self.spark.read.schema(schema).parquet(path).select("*", place.alias(order)))
        return reduce(DataFrame.unionAll, parts)

    def known(self, names: dict[str, str]) -> ParquetFiles:
        out = ParquetFiles(self.spark, self.paths, self.summaries)
        out._frame, out._footers, out.names = self._frame, self._footers, names
        return out

    def summary(self, wanted: list[tuple[str, str | None, Column | None]]) -> DataFrame | None:
        """count, min and max of integers and dates from the footers, which are read here and now. Files that lack
        statistics, and rows groups of nothing but NULL, give None: then the rows are read, as for any aggregate."""
        kinds = {f.name: f.dataType for f in self.frame().schema.fields}
        calls = []
        for id_, name, column in wanted:
            file_name = self.names.get(column.id) if column else None
            kind = kinds.get(file_name)
            whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType))
            if name == "count" and (column is None or file_name):
                calls.append(F.count(F.lit(1) if column is None else F.col(f"`{file_name}`")).alias(id_))
            elif name in ("min", "max") and whole:
                calls.append((F.min if name == "min" else F.max)(F.col(f"`{file_name}`")).alias(id_))
            else:
                return None
        if not self.summaries or len({n.lower() for n in kinds}) < len(kinds):
            return None
        try:
            if not self._footers:
                session = self.spark.newSession()  # with settings of its own
                for key, value in _BY_FOOTERS.items():
                    session.conf.set(key, value)
                self._footers.append(session.read.schema(self.frame().schema).parquet(*self.paths))
            found = self._footers[0].agg(*calls)
            if "PushedAggregation: []" in found._jdf.queryExecution().executedPlan().toString():
                return None
            (row,) = found.collect()
        except Exception:  # Spark's source fails, in one of several ways, where a footer doesn't tell
            return None
        days = lambda v: (v - date(1970, 1, 1)).days if isinstance(v, date) else v
        values = [days(v) for v in row]
        return self.spark.range(0, 1, 1, 1).select(*(F.lit(v).cast("bigint").alias(id_) for v, (id_, _, _) in zip(values, wanted)))


_BY_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def values(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    """A table in memory, of columns of integers, doubles or strings, with NULLs (None)."""
    kinds = {int: "bigint", float: "double", str: "string"}
    shape = []
    for name, of in columns.items():
        types = {type(v) for v in of if v is not None}
        if len(types) > 1 or not types <= kinds.keys():
            raise UnsupportedTable(f"column {name} isn't of one type")
        shape.append(f"`{name}` {kinds[types.pop()] if types else 'bigint'}")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(shape))


def sequence(spark: SparkSession, name: str, start: int, end: int) -> DataFrame:
    """Ids from start up to end, stored as nothing but their bounds."""
    return spark.range(start, end).withColumnRenamed("id", name)


Table = DataFrame | ParquetFiles


class Catalog:
    """Tables by name, case-sensitive. A table is a DataFrame, Parquet files, or a function that gives one when first asked."""

    def __init__(self, tables: dict[str, Table | Callable[[], Table | None]] | None = None, fallback: Callable[[str], Table | None] | None = None):
        self._tables, self._fallback = dict(tables or {}), fallback

    @classmethod
    def directory(cls, spark: SparkSession, folder: str, names: Sequence[str]) -> Catalog:
        return cls({n: ParquetFiles(spark, [f"{folder}/{n}.parquet"]) for n in names})

    def copy(self) -> Catalog:
        return Catalog(self._tables, self._fallback)

    def add(self, name: str, table: Table) -> None:
        self._tables[name] = table

    def find(self, name: str) -> Table | None:
        found = self._tables.get(name)
        if found is None:
            return self._fallback(name) if self._fallback else None
        if not isinstance(found, (DataFrame, ParquetFiles)):
            found = self._tables[name] = found()
        return found
