"""Every query with SQL beside it gives DuckDB's rows, names and types."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from sluice.queries import ORACLE_SQL, QUERIES, TABLES

#: How the types of the language print in both.
KIND = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return connection


def row(values):
    return tuple(float(f"{v:.12g}") if isinstance(v, float) and math.isfinite(v) else v for v in values)


def key(r):
    return [(v is not None, str(type(v)), v if v is not None else 0) for v in r]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    frame, wanted = QUERIES[name](spark, data), duck.sql(ORACLE_SQL[name])
    assert [(c, k) for c, k in frame.dtypes] == [(c, KIND[str(k)]) for c, k in zip(wanted.columns, wanted.types)]
    got, rows = (sorted((row(r) for r in rs), key=key) for rs in (frame.collect(), wanted.fetchall()))
    assert got == rows


def test_entry(spark):
    assert [r["event_type"] for r in entry(spark).collect()]
