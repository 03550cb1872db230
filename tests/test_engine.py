"""Queries end to end, most of them drawn at random and held against plain Python over the same rows."""

import itertools
import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.engine import Engine
from sluice.operators import stages
from sluice.operators.relation import Relation
from sluice.plans.errors import Code, Failure, QueryError, RunError, run_errors
from sluice.queries import EXTENDED, ORACLE_SQL, QUERIES
from sluice.sources.tables import ParquetFiles, UnsupportedTable, relation

# Rivers: made-up rows with NULLs, ties, zeros and strings of several alphabets.

NAMES = ["Aare", "Ohře", "", "Тиса", "a_b", "100%", "it's", "\\", "河", None]
RIVERS = [
    {"row": k, "km": r.choice([None, 0, 3, -7, 12, 250]), "towns": r.choice([None, 0, 1, 2, 5]), "flow": r.choice([None, 0.0, -0.5, 2.25, 1e9, math.inf]), "name": r.choice(NAMES)}
    for r in [random.Random(20)]
    for k in range(60)
]
SHAPE = "row long, km long, towns long, flow double, name string"


@pytest.fixture(scope="module")
def rivers(spark):
    frame = spark.createDataFrame([tuple(r.values()) for r in RIVERS], SHAPE).coalesce(1)
    return Engine(spark, {"rivers": frame}, EXTENDED, ordered=True)


def column(engine, query):
    return [r[0] for r in engine.sql(query).collect()]


# Computed columns against an evaluator

INTEGERS = st.one_of(st.sampled_from(["km", "towns"]).map(lambda n: ("column", n)), st.integers(-9, 9).map(lambda n: ("literal", n)))
STRINGS = st.one_of(st.just(("column", "name")), st.sampled_from(["", "a", "Ohře", "it's", "Тиса", "河"]).map(lambda s: ("literal", s)))
PATTERNS = st.lists(st.sampled_from(["%", "_", "a", "i", "е", "'", "\\", "e"]), max_size=4).map("".join)
COMPARE = st.sampled_from(["=", "!=", "<", "<=", ">", ">="])


def larger(inner):
    return st.one_of(
        st.tuples(st.sampled_from(["+", "-", "*", "/", "%"]), inner, inner),
        st.tuples(st.just("minus"), inner),
        st.tuples(COMPARE, inner, inner),
        st.tuples(COMPARE, STRINGS, STRINGS),
        st.tuples(COMPARE, st.just(("column", "flow")), st.integers(-3, 3).map(lambda n: ("literal", n))),
        st.tuples(st.just("like"), STRINGS, PATTERNS),
        st.tuples(st.sampled_from(["is null", "is not null"]), inner),
        st.tuples(st.just("iif"), inner, INTEGERS, INTEGERS),
        st.tuples(st.just("coalesce"), inner, INTEGERS, INTEGERS),
        st.tuples(st.just("case"), inner, INTEGERS, INTEGERS, INTEGERS),
        st.tuples(st.sampled_from(["length", "octet_length"]), STRINGS),
    )


EXPRESSIONS = st.recursive(INTEGERS, larger, max_leaves=6)


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def text_of(e):
    kind, *of = e
    if kind == "column":
        return of[0]
    if kind == "literal":
        return quoted(of[0]) if isinstance(of[0], str) else str(of[0])
    if kind == "like":
        return f"({text_of(of[0])} LIKE {quoted(of[1])})"
    if kind == "minus":
        return f"(- {text_of(of[0])})"
    if kind in ("is null", "is not null"):
        return f"({text_of(of[0])} {kind})"
    if kind == "case":
        return f"CASE {text_of(of[0])} WHEN {text_of(of[1])} THEN {text_of(of[2])} ELSE {text_of(of[3])} END"
    if kind in ("iif", "coalesce", "length", "octet_length"):
        return f"{kind}({', '.join(map(text_of, of))})"
    return f"({text_of(of[0])} {kind} {text_of(of[1])})"


def matches(text, pattern):
    """LIKE over bytes, by the sets of places in the text that a beginning of the pattern can end at."""
    raw, ends = text.encode(), {0}
    for c in pattern.encode():
        if c == ord("%"):
            ends = set(range(min(ends), len(raw) + 1)) if ends else ends
        else:
            ends = {e + 1 for e in ends if e < len(raw) and (c == ord("_") or raw[e] == c)}
    return len(raw) in ends


def holds(operator, x, y):
    if x is None or y is None:
        return None
    if isinstance(x, str):
        x, y = x.encode(), y.encode()
    return int({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[operator])


def value_of(e, row):
    kind, *of = e
    if kind == "column":
        return row[of[0]]
    if kind == "literal":
        return of[0]
    if kind == "like":
        x = value_of(of[0], row)
        return None if x is None else int(matches(x, of[1]))
    x, *others = (value_of(a, row) for a in of)
    if kind in ("is null", "is not null"):
        return int((x is None) == (kind == "is null"))
    if kind == "iif":
        return others[0] if x else others[1]
    if kind == "coalesce":
        return next((v for v in (x, *others) if v is not None), None)
    if kind == "case":
        return others[1] if x is not None and x == others[0] else others[2]
    if kind in ("length", "octet_length"):
        return None if x is None else len(x if kind == "length" else x.encode())
    if x is None or None in others:
        return None
    if kind == "minus":
        return -x
    (y,) = others
    if kind in ("/", "%"):
        whole = None if y == 0 else abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        return whole if kind == "/" or whole is None else x - y * whole
    return {"+": x + y, "-": x - y, "*": x * y}[kind] if kind in "+-*" else holds(kind, x, y)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(EXPRESSIONS, min_size=8, max_size=8))
def test_computed_columns(rivers, expressions):
    got = rivers.sql("FROM rivers |> SELECT " + ", ".join(f"{text_of(e)} AS x{k}" for k, e in enumerate(expressions))).collect()
    for e, values in zip(expressions, zip(*got)):
        assert list(values) == [value_of(e, r) for r in RIVERS], text_of(e)


# Conditions against an evaluator of three values

CONDITION_LEAVES = st.one_of(
    st.tuples(st.just("test"), st.sampled_from(["km", "towns"]), COMPARE, st.integers(-8, 13)),
    st.tuples(st.just("test"), st.just("name"), COMPARE, st.sampled_from(["", "a", "it's", "Тиса"])),
    st.tuples(st.just("test"), st.just("flow"), COMPARE, st.integers(-1, 3)),
    st.tuples(st.just("among"), st.sampled_from(["km", "towns"]), st.lists(st.integers(-8, 13), min_size=1, max_size=4)),
    st.tuples(st.just("among"), st.just("name"), st.lists(st.sampled_from(["", "河", "it's"]), min_size=1, max_size=3)),
    st.tuples(st.just("like"), st.just("name"), PATTERNS),
    st.tuples(st.just("null"), st.sampled_from(["km", "flow", "name"]), st.booleans()),
)
CONDITIONS = st.recursive(CONDITION_LEAVES, lambda c: st.one_of(st.tuples(st.just("not"), c), st.tuples(st.sampled_from(["and", "or"]), c, c)), max_leaves=6)


def literal(v):
    return quoted(v) if isinstance(v, str) else str(v)


def condition_text(c):
    kind, *of = c
    if kind == "not":
        return f"NOT ({condition_text(of[0])})"
    if kind in ("and", "or"):
        return f"({condition_text(of[0])}) {kind} ({condition_text(of[1])})"
    if kind == "test":
        return f"{of[0]} {of[1]} {literal(of[2])}"
    if kind == "among":
        return f"{of[0]} IN ({', '.join(map(literal, of[1]))})"
    return f"{of[0]} LIKE {quoted(of[1])}" if kind == "like" else f"{of[0]} IS {'NOT ' if of[1] else ''}NULL"


def truth(c, row):
    kind, *of = c
    if kind == "not":
        x = truth(of[0], row)
        return None if x is None else not x
    if kind in ("and", "or"):
        both = {truth(of[0], row), truth(of[1], row)}
        return next(t for t in ((False, None, True) if kind == "and" else (True, None, False)) if t in both)
    v = row[of[0]]
    if kind == "null":
        return (v is None) != of[1]
    if v is None:
        return None
    return bool(holds(of[1], v, of[2])) if kind == "test" else v in of[1] if kind == "among" else matches(v, of[1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(CONDITIONS, min_size=1, max_size=3))
def test_conditions_keep_what_is_true(rivers, conditions):
    for c in conditions:
        assert column(rivers, f"FROM rivers |> WHERE {condition_text(c)} |> SELECT row") == [r["row"] for r in RIVERS if truth(c, r)], condition_text(c)


# Aggregates, sorts and limits against Python


@pytest.mark.parametrize("key", ["km", "name", "towns"])
def test_groups_are_as_first_seen(rivers, key):
    got = [tuple(r) for r in rivers.sql(f"FROM rivers |> AGGREGATE count(*) AS n, count(km) AS c, sum(km) AS s, avg(km) AS m, min(name) AS a, max(towns) AS b, count(DISTINCT towns) AS d, sum(DISTINCT km) AS e GROUP BY {key} AS k").collect()]
    wanted = []
    for value in dict.fromkeys(r[key] for r in RIVERS):
        rows = [r for r in RIVERS if r[key] == value]
        km, towns = ([r[c] for r in rows if r[c] is not None] for c in ("km", "towns"))
        names = [r["name"].encode() for r in rows if r["name"] is not None]
        least = min(names).decode() if names else None
        wanted.append((value, len(rows), len(km), sum(km) if km else None, sum(km) / len(km) if km else None, least, max(towns, default=None), len(set(towns)), sum(set(km)) if km else None))
    assert got == wanted


def test_averages_are_exact(spark):
    big = (1 << 63) - 5
    engine = Engine(spark, {"t": spark.createDataFrame([(big,), (None,), (big,), (big - 4,)], "x long")})
    row = engine.sql("FROM t |> AGGREGATE avg(x) AS m, count(*) AS n, count(x) AS c").collect()[0]
    assert tuple(row) == ((big + big + big - 4) / 3, 4, 3)
    assert tuple(engine.sql("FROM t |> WHERE x IS NULL |> AGGREGATE sum(x), avg(x), min(x), count(x), count(*)").collect()[0]) == (None, None, None, 0, 1)


def test_wide_averages(spark):
    """Averages of what doesn't fit 64 bits, grouped, of distinct values and of columns set again; all else still fails."""
    k, rows = 600_000_000_000_001, [(g, x) for g, x in zip([1, 1, 2, 2, 2], [150_000, 149_999, 9, 9, None])]
    frame = spark.createDataFrame(rows, "g long, x long")
    exact = Engine(spark, {"t": frame}, EXTENDED, wide_averages=True)
    got = exact.rows(f"FROM t |> EXTEND x * {k} - 1 AS y |> SET y = y + 1 |> RENAME y AS z |> AGGREGATE avg(z) AS m, avg(DISTINCT z) AS d, count(x) AS n GROUP BY g |> ORDER BY g")
    assert [tuple(r) for r in got] == [(1, 299_999 * k / 2, 299_999 * k / 2, 2), (2, 9 * k, 9 * k, 2)]
    assert exact.rows("FROM t |> SELECT x * 2 AS y |> UNIQUE |> AGGREGATE avg(y) AS m, count(*) AS n")[0] == (2 * 300_008 / 3, 4)
    assert exact.rows(f"FROM t |> SELECT x * {k} AS y, g |> AGGREGATE count(*) AS n GROUP BY g |> AGGREGATE avg(n) AS m")[0]["m"] == 2.5
    joined = exact.then(exact.then(exact.table("t"), f"EXTEND x * {k} AS y").join_n1(relation(spark.range(3)), "g", "id"), "AGGREGATE avg(y) AS m")
    assert joined.result().collect()[0]["m"] == (299_999 + 18) * k / 4
    for query in (f"EXTEND x * {k} AS y |> AGGREGATE sum(y) AS s", f"SELECT x * {k} AS y", f"EXTEND x * {k} AS y |> WHERE y > 0 |> AGGREGATE avg(y) AS m", f"EXTEND x * {k} / 2 AS y |> AGGREGATE avg(y) AS m"):
        with pytest.raises(RunError) as caught:
            exact.rows(f"FROM t |> {query}")
        assert caught.value.failure == Failure.OVERFLOW
    with pytest.raises(RunError):
        Engine(spark, {"t": frame}).rows(f"FROM t |> EXTEND x * {k} AS y |> AGGREGATE avg(y) AS m")


def test_agg_avg_exact_of_large_keys(spark, tmp_path):
    """As many orders as in sf0.1, whose products leave 64 bits from the 15,373rd on, and 60 times as many: rows of the SQL."""
    for n in (150_000, 9_000_000):
        folder = str(tmp_path / str(n))
        spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{folder}/orders.parquet")
        sql = ORACLE_SQL["agg_avg_exact"].replace("FROM orders", f"FROM '{folder}/orders.parquet/*.parquet'")
        assert [tuple(r) for r in QUERIES["agg_avg_exact"](spark, folder).collect()] == duckdb.sql(sql).fetchall()


def key_of(v, descending):
    return (v is None, 0) if descending and v is None else (v is not None, 0 if v is None else v.encode() if isinstance(v, str) else v)


@pytest.mark.parametrize("keys", [(("km", False),), (("name", True), ("towns", False)), (("towns", True), ("flow", True)), (("flow", False), ("name", False))])
def test_sorts_are_stable(rivers, keys):
    rows = list(RIVERS)
    for name, descending in reversed(keys):
        nulls, others = [r for r in rows if r[name] is None], [r for r in rows if r[name] is not None]
        others.sort(key=lambda r: r[name].encode() if isinstance(r[name], str) else r[name], reverse=descending)
        rows = others + nulls if descending else nulls + others
    if keys[-1][1] or any(d for _, d in keys):  # Python's reverse keeps ties in order, as the engine does
        rows = list(rows)
    wanted = [r["row"] for r in rows]
    order = "FROM rivers |> ORDER BY " + ", ".join(f"{n}{' DESC' if d else ''}" for n, d in keys)
    assert column(rivers, f"{order} |> SELECT row") == wanted
    for n, skipped in ((0, 0), (1, 0), (7, 11), (500, 3), (5, 500)):
        assert column(rivers, f"{order} |> LIMIT {n} OFFSET {skipped} |> SELECT row") == wanted[skipped : skipped + n]
    assert column(rivers, f"FROM rivers |> LIMIT 9 OFFSET 4 |> ORDER BY {keys[0][0]} |> ORDER BY row DESC |> SELECT row") == list(range(12, 3, -1))


def test_order_is_that_of_the_files(spark, tmp_path):
    """Files of unequal size: Spark packs the large ones first, their rows still come as listed."""
    sizes = {"b": 4, "a": 1_000_000, "c": 30}
    begin = 0
    for name, n in sizes.items():
        pq.write_table(pa.table({"v": pa.array(range(begin, begin + n)), "w": pa.array([k % 3 for k in range(n)])}), tmp_path / f"{name}.parquet", row_group_size=100_000)
        begin += n
    engine = Engine(spark, ordered=True)
    engine.register_parquet("t", *(f"{tmp_path}/{n}.parquet" for n in sizes))
    engine.register_parquet("folder", str(tmp_path))
    assert column(engine, "FROM t |> LIMIT 6 |> SELECT v") == [0, 1, 2, 3, 4, 5]
    assert column(engine, "FROM t |> LIMIT 4 OFFSET 1000002 |> SELECT v") == [1_000_002, 1_000_003, 1_000_004, 1_000_005]
    assert column(engine, "FROM t |> ORDER BY w DESC |> LIMIT 3 |> SELECT v") == [2, 6, 9]
    assert column(engine, "FROM t |> EXTEND v / 3 AS k |> AGGREGATE count(*) AS n GROUP BY k |> LIMIT 3") == [0, 1, 2]
    assert column(engine, "FROM folder |> LIMIT 2 |> SELECT v") == [4, 5]  # by file name within a folder


def most_read(spark, run):
    """What run gives, and the most rows that one of its tasks read from a shuffle."""
    context = spark._jsparkSession.sparkContext()

    def ran():
        context.listenerBus().waitUntilEmpty()
        listed = context.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return [(s.stageId(), s.attemptId()) for s in (listed.apply(k) for k in range(listed.size()))]

    before = set(ran())
    out, most = run(), 0
    for stage in set(ran()) - before:
        tasks = context.statusStore().taskList(*stage, 1000)
        most = max([most, *(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in (tasks.apply(k) for k in range(tasks.size())) if t.taskMetrics().isDefined())])
    return out, most


@pytest.fixture(scope="module")
def walked(spark, tmp_path_factory):
    """A folder of three files and a fourth file, as one table: 50 rows, numbered; and places, whose blocks are of 4 rows."""
    folder, start = tmp_path_factory.mktemp("walked"), 0
    for path, n in (("some/a.parquet", 17), ("some/b.parquet", 3), ("some/c.parquet", 21), ("another.parquet", 9)):
        (folder / path).parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({"v": range(start, start + n), "w": [v * 7 % 5 for v in range(start, start + n)]}), folder / path)
        start += n
    engine = Engine(spark, ordered=True)
    engine.register_parquet("t", str(folder / "some"), str(folder / "another.parquet"))
    return engine


def test_large_limits_by_blocks(spark, walked, monkeypatch):
    """Slices of rows in source order, where none is gathered: within a block, over blocks and files, at and past the end."""
    monkeypatch.setattr(stages, "_TAKEN_MAX", 0)
    monkeypatch.setattr(stages, "_BLOCK_BITS", 2)
    rows = list(range(50))
    for n, skipped in ((1, 0), (3, 1), (8, 16), (5, 38), (50, 0), (60, 0), (60, 49), (3, 50), (3, 700), (0, 4), (1, 19)):
        assert column(walked, f"FROM t |> LIMIT {n} OFFSET {skipped} |> SELECT v") == rows[skipped : skipped + n]
    odd = [v for v in rows if v * 7 % 5 not in (0, 3)]
    assert column(walked, "FROM t |> WHERE NOT w IN (0, 3) |> EXTEND v + 1 AS u |> LIMIT 20 OFFSET 7 |> LIMIT 9 OFFSET 3 |> SELECT u") == [v + 1 for v in odd[7:27][3:12]]
    assert column(walked, "FROM t |> WHERE v > 2 |> AGGREGATE count(*) AS n GROUP BY w |> LIMIT 3 OFFSET 1 |> SELECT w") == [3, 0, 2]
    assert column(walked, "FROM t |> ORDER BY w |> LIMIT 4 OFFSET 9 |> SELECT v") == [45, 3, 8, 13]
    assert column(walked, "FROM t |> LIMIT 30 OFFSET 10 |> ORDER BY w DESC |> LIMIT 2 |> SELECT v") == [12, 17]
    joined = walked.table("t").join_n1(relation(spark.range(1, 4)), "w", "id")
    got = walked.then(joined, "LIMIT 5 OFFSET 6").frame
    assert sorted(r[0] for r in got.select(joined.scope[0].id).collect()) == [v for v in rows if v * 7 % 5 in (1, 2, 3)][6:11]
    walked.register_parquet("none", walked.catalog.find("t").paths[1])
    assert column(walked, "FROM none |> WHERE v > 99 |> LIMIT 2 OFFSET 1") == []


def test_order_multi_file_gathers_no_table(spark, tmp_path):
    """A task holds blocks of rows, however many rows LIMIT and OFFSET pass over; it was both copies of the table."""
    n = 300_000
    spark.range(0, n, 1, 3).select(F.col("id").alias("o_orderkey"), (-F.col("id")).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    rows, most = most_read(spark, lambda: QUERIES["order_multi_file"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in rows] == [(k % n, -(k % n)) for k in range(n - 3, n + 4)]
    assert 0 < most <= 2 << 16


# Joins


def test_joins_add_the_one_partner(spark):
    r = random.Random(4)
    guests = [(k, r.choice([None, *range(-2, 40)])) for k in range(200)]
    rooms = [(k, f"room {k}") for k in r.sample(range(40), 25)]
    engine = Engine(spark, {"guests": spark.createDataFrame(guests, "guest long, room long"), "rooms": spark.createDataFrame([*rooms, (None, "none")], "id long, sign string")})
    joined = engine.table("guests").join_n1(engine.table("rooms"), "ROOM", "id", ["Sign"])
    got = [tuple(x) for x in engine.then(joined, "WHERE guest >= 20 |> SELECT guest, sign |> ORDER BY guest").result().collect()]
    assert got == [(g, dict(rooms)[k]) for g, k in guests if k in dict(rooms) and g >= 20]
    twice = engine.table("rooms").join_n1(engine.table("rooms"), "id", "id").result()
    assert twice.columns == ["id", "sign", "id", "sign"] and twice.count() == len(rooms)


def test_joins_refuse_a_key_that_stands_twice(spark):
    engine = Engine(spark, {"a": spark.range(5), "b": spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4), (3, 5)], "k long, v long")})
    refused = engine.table("a").join_n1(engine.table("b"), "id", "k").result()
    with pytest.raises(RunError) as found, run_errors():
        refused.collect()
    assert found.value.failure == Failure.UNSUPPORTED and "k isn't unique" in str(found.value)
    trusted = engine.table("a").join_n1(engine.table("b"), "id", "k", trust_unique=True).result()
    assert sorted(x["v"] for x in trusted.collect()) == [1, 2, 5]
    with pytest.raises(TypeError):
        engine.table("a").join_n1(Engine(spark, {"s": spark.createDataFrame([("x",)], "k string")}).table("s"), "id", "k")
    with pytest.raises(KeyError):
        engine.table("a").join_n1(engine.table("b"), "id", "k", ["missing"])


# Failures of runs


def test_failures_of_runs_have_kinds(spark, tmp_path):
    engine = Engine(spark, {"t": spark.range(3)})
    path = f"{tmp_path}/gone.parquet"
    spark.range(3).write.parquet(path)
    engine.register_parquet("gone", path)
    for f in (tmp_path / "gone.parquet").glob("part-*"):
        f.write_bytes(b"not at all a file of columns")
    for query, failure in (("FROM t |> SELECT id - 9223372036854775807 - 2 AS x", Failure.OVERFLOW), ("FROM gone |> SELECT id", Failure.CORRUPT)):
        with pytest.raises(RunError) as found:
            engine.rows(query)
        assert found.value.failure == failure and found.value.__cause__ is not None
    assert engine.rows("FROM t |> WHERE id > 7 |> SELECT id * 9223372036854775807 AS x") == []


# Tables


def test_names_of_results(rivers):
    columns = lambda q: rivers.sql("FROM rivers |> " + q).columns
    assert columns("SELECT towns, km, towns") == ["towns", "km", "towns"]
    assert columns("EXTEND km AS far, name |> DROP Row, TOWNS, flow, NAME") == ["km", "far"]
    assert columns("RENAME km AS towns, TOWNS AS km |> SET KM = 0") == ["row", "towns", "km", "flow", "name"]
    assert columns("AGGREGATE Count(*), avg(KM) AS mean, min(DISTINCT name) GROUP BY towns AS size, km") == ["size", "km", "count(*)", "mean", "min(DISTINCT name)"]


def test_types_of_tables(spark, tmp_path):
    path = f"{tmp_path}/kinds"
    one = spark.sql(
        "SELECT 100Y AS tiny, -5S AS small, 70000 AS mid, 0.25F AS light, DATE'1969-12-30' AS day, TIMESTAMP'1970-01-02 00:00:00.5' AS at, TIMESTAMP_NTZ'1969-12-31 23:59:59' AS local, "
        "X'FF61' AS raw, X'C3A9' AS accented, false AS flag, named_struct('x', 1) AS nested, 1.50BD AS money"
    )
    one.write.parquet(path)
    with pytest.raises(UnsupportedTable, match="flag"):
        Engine(spark, {"t": spark.read.parquet(path)}).compile("FROM t")
    engine = Engine(spark, strict=False)
    engine.register_parquet("t", path)
    frame = engine.sql("FROM t")
    assert [f.dataType for f in frame.schema] == [T.LongType()] * 3 + [T.DoubleType()] + [T.LongType()] * 3 + [T.StringType()] * 2
    assert tuple(frame.select(*frame.columns[:7], "accented").collect()[0]) == (100, -5, 70000, 0.25, -2, 86_400_500_000, -1_000_000, "é")
    assert column(engine, "FROM t |> SELECT octet_length(raw) AS n") == [2] and column(engine, "FROM t |> WHERE raw LIKE '_a' |> SELECT mid") == [70000]
    other = f"{tmp_path}/other"
    spark.range(1).write.parquet(other)
    with pytest.raises(UnsupportedTable, match="other columns"):
        engine.register_parquet("two", path, other)
    engine.register_values("v", {"a": [1, None], "b": [None, None], "c": ["x", None], "d": [0.5, 1.5]})
    assert [tuple(r) for r in engine.rows("FROM v |> ORDER BY d")] == [(1, None, "x", 0.5), (None, None, None, 1.5)]
    with pytest.raises(UnsupportedTable):
        engine.register_values("w", {"a": [1, "x"]})


def test_names_in_scope(spark):
    engine = Engine(spark, {"twins": spark.createDataFrame([(1, 2)], "x long, y long").toDF("Left", "LEFT")})
    with pytest.raises(QueryError) as found:
        engine.compile("FROM twins |> SELECT left")
    assert (found.value.code, found.value.span.start) == (Code.DUPLICATE_COLUMN, 5)


def test_ansi_is_required(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError):
            Engine(spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_streams(spark, tmp_path):
    spark.range(9).selectExpr("id", "id % 2 AS odd").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, odd long").parquet(f"{tmp_path}/in")
    out = Engine(spark).stream(stream, "WHERE odd = 1 |> EXTEND id * id AS square |> SELECT square")
    query = out.writeStream.format("memory").queryName("squares").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert Counter(r["square"] for r in spark.table("squares").collect()) == Counter([1, 9, 25, 49])


def test_relations_of_other_frames(spark):
    made = relation(spark.range(4).withColumn("ID2", F.col("id") * 2))
    assert isinstance(made, Relation) and [c.name for c in made.scope] == ["id", "ID2"]


# Plans


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scans_take_filters_and_columns(spark, data):
    engine = Engine(spark)
    for name in ("lineitem", "part", "events"):
        engine.register_parquet(name, f"{data}/{name}.parquet")
    lines = plan(engine.sql("FROM lineitem |> WHERE l_suppkey <= 4 AND NOT l_linestatus = 'F' |> EXTEND l_tax * 2 AS t |> SELECT l_suppkey, t"))
    assert "LessThanOrEqual(l_suppkey,4)" in lines and "Not(EqualTo(l_linestatus,F))" in lines
    assert "ReadSchema: struct<l_suppkey:bigint,l_tax:double,l_linestatus:string>" in lines
    assert "LessThan(p_size,7)" in plan(engine.sql("FROM part |> WHERE p_size < 7"))
    assert "GreaterThan(ts,2023-11-14T22:13:20)" in plan(engine.sql("FROM events |> WHERE ts > 1700000000000000"))
    after = plan(engine.sql("FROM lineitem |> AGGREGATE count(*) AS n GROUP BY l_linestatus |> WHERE l_linestatus = 'O' AND n > 3"))
    assert "EqualTo(l_linestatus,O)" in after and "Python" not in after
    assert "TakeOrderedAndProject" in plan(engine.sql("FROM lineitem |> ORDER BY l_tax DESC, l_orderkey |> LIMIT 4"))
    sorted_twice = plan(engine.sql("FROM part |> ORDER BY p_size |> ORDER BY p_name |> SELECT p_name"))
    assert sorted_twice.count("Sort [") == 1


@pytest.mark.parametrize("kind, unit", [("date", 86_400), ("timestamp", 1)])
def test_scans_skip_row_groups_by_time(spark, tmp_path, kind, unit):
    seconds = [k * 86_400 for k in range(50_000)]
    array = pa.array([s // 86_400 for s in seconds], pa.int32()).cast(pa.date32()) if kind == "date" else pa.array([s * 1_000_000 for s in seconds], pa.timestamp("us", tz="UTC"))
    pq.write_table(pa.table({"at": array}), tmp_path / "t.parquet", row_group_size=5000)
    engine = Engine(spark)
    engine.register_parquet("t", f"{tmp_path}/t.parquet")
    n = 47_003 if kind == "date" else 47_003 * 86_400 * 1_000_000
    frame = engine.sql(f"FROM t |> WHERE at >= {n} |> SELECT at")
    assert len(frame.collect()) == 50_000 - 47_003 and frame.collect()[0]["at"] == n
    node = frame._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    assert node.metrics().apply("numOutputRows").value() == 5000  # one row group of ten


def test_footers_answer_aggregates_of_whole_tables(spark, tmp_path):
    rows = [None if k % 7 == 0 else k * 3 - 50 for k in range(1000)]
    days = pa.array([k % 40 for k in range(1000)], pa.int32()).cast(pa.date32())
    pq.write_table(pa.table({"x": pa.array(rows, pa.int32()), "d": days, "s": ["t"] * 1000}), tmp_path / "t.parquet", row_group_size=100)
    pq.write_table(pa.table({"x": pa.array([None] * 50 + [1] * 50, pa.int64())}), tmp_path / "nulls.parquet", row_group_size=50)
    pq.write_table(pa.table({"x": pa.array([1, 2, 3], pa.int64())}), tmp_path / "bare.parquet", write_statistics=False)
    engine = Engine(spark)
    for name in ("t", "nulls", "bare"):
        engine.register_parquet(name, f"{tmp_path}/{name}.parquet")
    known = [x for x in rows if x is not None]
    frame = engine.sql("FROM t |> EXTEND x * 2 AS y |> RENAME x AS z |> AGGREGATE count(*) AS n, count(z) AS c, min(z) AS a, max(DISTINCT z) AS b, max(d) AS e")
    assert tuple(frame.collect()[0]) == (1000, len(known), min(known), max(known), 39) and "Scan" not in plan(frame)
    for query, wanted in (
        ("FROM t |> WHERE x > 100 |> AGGREGATE count(*), min(x)", (sum(x > 100 for x in known), min(x for x in known if x > 100))),
        ("FROM t |> LIMIT 5 |> AGGREGATE count(*)", (5,)),
        ("FROM t |> AGGREGATE min(s), sum(x)", ("t", sum(known))),
        ("FROM t |> EXTEND x + 1 AS y |> AGGREGATE max(y)", (max(known) + 1,)),
        ("FROM nulls |> AGGREGATE min(x), count(x)", (1, 50)),
        ("FROM bare |> AGGREGATE min(x), count(x), count(*)", (1, 3, 3)),
    ):
        assert tuple(engine.sql(query).collect()[0]) == wanted, query
    assert ParquetFiles(spark, [f"{tmp_path}/t.parquet"], summaries=False).known({}).summary([("n", "count", None)]) is None


def test_nothing_runs_while_compiling(spark, rivers):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for query in itertools.islice(("WHERE km > 1", "AGGREGATE sum(km) GROUP BY name", "ORDER BY km |> LIMIT 2", "EXTEND km / 2 AS x"), 4):
        rivers.sql("FROM rivers |> " + query)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
