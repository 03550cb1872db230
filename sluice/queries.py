"""Queries over the benchmark tables, one or more for each operator of the engine, and the same as SQL."""

from __future__ import annotations

import contextlib
import io
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice import explain
from sluice.engine import STANDARD, Engine
from sluice.functions.scalar import function
from sluice.operators.relation import Relation, fresh
from sluice.plans.errors import Code, QueryError, RunError, Span, run_errors
from sluice.plans.registry import StageRule
from sluice.plans.types import Column, Scope, Type
from sluice.sources.tables import Catalog, relation, sequence, values

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

#: A moment within the events.
_NOON = 1_704_110_400_000_000
#: name: (pipe query, SQL). Both give the same names, types and rows.
PIPES: dict[str, tuple[str, str]] = {
    "flagship": (
        "FROM events |> WHERE event_type != 'error' |> AGGREGATE count(*) AS n, count(DISTINCT user_id) AS users GROUP BY event_type |> ORDER BY n DESC, event_type |> LIMIT 3",
        "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'error' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3",
    ),
    "scan_all": ("FROM customer", "SELECT * REPLACE (c_nationkey::BIGINT AS c_nationkey) FROM customer"),
    "scan_types": ("FROM orders |> SELECT o_orderkey, o_orderdate, o_totalprice", "SELECT o_orderkey, epoch_us(o_orderdate) AS o_orderdate, o_totalprice FROM orders"),
    "scan_select": ("FROM nation |> SELECT n_name, n_nationkey", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation"),
    "extend_arith": ("FROM part |> EXTEND p_size * 2 + 1 AS x |> SELECT p_partkey, x", "SELECT p_partkey, p_size::BIGINT * 2 + 1 AS x FROM part"),
    "extend_widens": ("FROM lineitem |> SELECT l_orderkey, l_linenumber, l_extendedprice * l_linenumber - l_tax AS x", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * l_linenumber::DOUBLE - l_tax AS x FROM lineitem"),
    "int_div_mod": (
        "FROM part |> SELECT p_partkey, p_partkey / p_size AS q, p_partkey % 7 AS r, -p_partkey % 7 AS s, p_partkey / (p_size - p_size) AS z, p_partkey % (p_size - p_size) AS y",
        "SELECT p_partkey, p_partkey // p_size::BIGINT AS q, p_partkey % 7 AS r, -p_partkey % 7 AS s, NULL::BIGINT AS z, NULL::BIGINT AS y FROM part",
    ),
    "float_div": ("FROM lineitem |> SELECT l_orderkey, l_linenumber, l_extendedprice / l_discount AS x", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice / nullif(l_discount, 0) AS x FROM lineitem"),
    "unary_minus": ("FROM part |> SELECT p_partkey, -p_size AS x, -(p_size - 30) AS y, -5 AS z", "SELECT p_partkey, -p_size::BIGINT AS x, -(p_size::BIGINT - 30) AS y, -5::BIGINT AS z FROM part"),
    "compare_01": (
        "FROM part |> SELECT p_partkey, p_size > 20 AS a, p_size = 7 AS b, p_size != 7 AS c, 10 >= p_size AS d, p_brand < 'Brand#3' AS e, p_retailprice >= 1000 AS f",
        "SELECT p_partkey, (p_size > 20)::BIGINT AS a, (p_size = 7)::BIGINT AS b, (p_size <> 7)::BIGINT AS c, (10 >= p_size)::BIGINT AS d, (p_brand < 'Brand#3')::BIGINT AS e, (p_retailprice >= 1000)::BIGINT AS f FROM part",
    ),
    "compare_null": (
        "FROM part |> EXTEND p_partkey / (p_size - 7) AS x |> SELECT p_partkey, x > 100 AS a, x IS NULL AS b, x IS NOT NULL AS c",
        "SELECT p_partkey, (x > 100)::BIGINT AS a, (x IS NULL)::BIGINT AS b, (x IS NOT NULL)::BIGINT AS c FROM (SELECT p_partkey, p_partkey // nullif(p_size::BIGINT - 7, 0) AS x FROM part)",
    ),
    "like_01": ("FROM part |> SELECT p_partkey, p_type LIKE '%a%' AS a, p_name LIKE '_e%' AS b", "SELECT p_partkey, (p_type LIKE '%a%')::BIGINT AS a, (p_name LIKE '_e%')::BIGINT AS b FROM part"),
    "where_and_or_not": (
        "FROM lineitem |> WHERE (l_orderkey > 100 OR l_linenumber = 1) AND NOT l_returnflag = 'R' AND 5 <= l_quantity |> SELECT l_orderkey, l_linenumber, l_quantity",
        "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey > 100 OR l_linenumber = 1) AND NOT l_returnflag = 'R' AND 5 <= l_quantity",
    ),
    "where_in_int": ("FROM part |> WHERE p_size IN (1, 2, 49, -3) |> SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 49, -3)"),
    "where_in_long": (f"FROM part |> WHERE NOT p_size IN ({', '.join(map(str, range(2, 40)))}) |> SELECT p_partkey", f"SELECT p_partkey FROM part WHERE p_size NOT IN ({', '.join(map(str, range(2, 40)))})"),
    "where_in_str": ("FROM events |> WHERE event_type IN ('click', 'view') |> SELECT event_id", "SELECT event_id FROM events WHERE event_type IN ('click', 'view')"),
    "where_like": ("FROM customer |> WHERE c_name LIKE '%1%2%' AND NOT c_mktsegment LIKE 'B%' |> SELECT c_custkey", "SELECT c_custkey FROM customer WHERE c_name LIKE '%1%2%' AND NOT c_mktsegment LIKE 'B%'"),
    "where_like_bytes": ("FROM documents |> WHERE lang LIKE '_e' AND text LIKE '%ü%' |> SELECT doc_id", "SELECT doc_id FROM documents WHERE lang LIKE '_e' AND text LIKE '%ü%'"),
    "where_null": (
        "FROM part |> EXTEND p_partkey / (p_size - 7) AS x |> WHERE x IS NULL OR p_size = 9 |> SELECT p_partkey",
        "SELECT p_partkey FROM part WHERE p_size = 7 OR p_size = 9",
    ),
    "where_strings": ("FROM part |> WHERE p_brand >= 'Brand#2' AND p_brand != 'Brand#21' |> SELECT p_partkey", "SELECT p_partkey FROM part WHERE p_brand >= 'Brand#2' AND p_brand <> 'Brand#21'"),
    "where_double": ("FROM orders |> WHERE o_totalprice > 200000 AND o_totalprice <= 300000 |> SELECT o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_totalprice <= 300000"),
    "where_computed": ("FROM lineitem |> EXTEND l_partkey > l_suppkey AS m |> WHERE m = 1 |> SELECT l_orderkey, l_partkey, l_suppkey", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey > l_suppkey"),
    "case_when": (
        "FROM part |> SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE p_brand END AS k, CASE p_size WHEN 1 THEN 10 WHEN 2 THEN 20 END AS v",
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE p_brand END AS k, CASE p_size WHEN 1 THEN 10 WHEN 2 THEN 20 END::BIGINT AS v FROM part",
    ),
    "iif_coalesce_ifnull": (
        "FROM part |> EXTEND p_partkey / (p_size - 7) AS x |> SELECT p_partkey, iif(p_size > 25, p_size, 0) AS a, coalesce(x, NULL, p_size) AS b, ifnull(x, -1) AS c",
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 0 END::BIGINT AS a, coalesce(x, p_size::BIGINT) AS b, coalesce(x, -1) AS c FROM (SELECT *, p_partkey // nullif(p_size::BIGINT - 7, 0) AS x FROM part)",
    ),
    "length_octet_length": ("FROM documents |> SELECT doc_id, length(text) AS n, octet_length(text) AS m", "SELECT doc_id, length(text) AS n, strlen(text) AS m FROM documents"),
    "drop": ("FROM supplier |> DROP s_acctbal, S_NAME", "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier"),
    "rename_swap": ("FROM nation |> RENAME n_nationkey AS n_regionkey, n_regionkey AS n_nationkey", "SELECT n_nationkey::BIGINT AS n_regionkey, n_name, n_regionkey::BIGINT AS n_nationkey FROM nation"),
    "set_all_at_once": ("FROM nation |> SET n_nationkey = n_regionkey * 10, n_regionkey = n_nationkey", "SELECT n_regionkey::BIGINT * 10 AS n_nationkey, n_name, n_nationkey::BIGINT AS n_regionkey FROM nation"),
    "agg_global": (
        "FROM lineitem |> AGGREGATE count(*) AS n, count(l_partkey) AS c, sum(l_suppkey) AS s, min(l_orderkey) AS a, max(l_orderkey) AS b, avg(l_partkey) AS m",
        "SELECT count(*) AS n, count(l_partkey) AS c, sum(l_suppkey)::BIGINT AS s, min(l_orderkey) AS a, max(l_orderkey) AS b, sum(l_partkey)::DOUBLE / count(l_partkey) AS m FROM lineitem",
    ),
    "agg_empty": ("FROM part |> WHERE p_size > 1000 |> AGGREGATE count(*) AS n, sum(p_size) AS s, avg(p_size) AS m", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, avg(p_size) AS m FROM part WHERE p_size > 1000"),
    "agg_group_int": ("FROM part |> AGGREGATE count(*) AS n, sum(p_partkey) AS s GROUP BY p_size", "SELECT p_size::BIGINT AS p_size, count(*) AS n, sum(p_partkey)::BIGINT AS s FROM part GROUP BY ALL"),
    "agg_group_str": ("FROM customer |> AGGREGATE count(*) AS n, max(c_custkey) AS m GROUP BY c_mktsegment AS segment", "SELECT c_mktsegment AS segment, count(*) AS n, max(c_custkey) AS m FROM customer GROUP BY ALL"),
    "agg_two_keys": ("FROM lineitem |> AGGREGATE count(*) AS n, avg(l_partkey) AS m GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_partkey)::DOUBLE / count(l_partkey) AS m FROM lineitem GROUP BY ALL"),
    "agg_null_key": ("FROM part |> EXTEND p_size / (p_size % 5) AS k |> AGGREGATE count(*) AS n, count(k) AS c GROUP BY k", "SELECT p_size::BIGINT // nullif(p_size::BIGINT % 5, 0) AS k, count(*) AS n, count(k) AS c FROM part GROUP BY ALL"),
    "agg_distinct": (
        "FROM lineitem |> AGGREGATE count(DISTINCT l_partkey) AS c, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber) AS m GROUP BY l_returnflag",
        "SELECT l_returnflag, count(DISTINCT l_partkey) AS c, sum(DISTINCT l_linenumber)::BIGINT AS s, sum(DISTINCT l_linenumber)::DOUBLE / count(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_min_max_str": ("FROM part |> AGGREGATE min(p_name) AS a, max(DISTINCT p_type) AS b GROUP BY p_brand", "SELECT p_brand, min(p_name) AS a, max(p_type) AS b FROM part GROUP BY p_brand"),
    "agg_avg_exact": ("FROM orders |> EXTEND o_orderkey * 600000000000001 AS x |> AGGREGATE avg(x) AS m", "SELECT sum(o_orderkey::HUGEINT * 600000000000001)::DOUBLE / count(*) AS m FROM orders"),
    "agg_then_where": ("FROM orders |> AGGREGATE count(*) AS n GROUP BY o_custkey |> WHERE n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "agg_of_agg": ("FROM events |> AGGREGATE count(*) GROUP BY user_id |> AGGREGATE count(*) AS users", "SELECT count(*) AS users FROM (SELECT user_id FROM events GROUP BY user_id)"),
    "order_limit": ("FROM customer |> ORDER BY c_custkey DESC |> LIMIT 10 |> SELECT c_custkey, c_name", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 10"),
    "order_limit_offset": ("FROM customer |> ORDER BY c_mktsegment, c_custkey |> LIMIT 7 OFFSET 20 |> SELECT c_custkey", "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 7 OFFSET 20"),
    "order_nulls": (
        "FROM part |> EXTEND p_partkey / (p_size % 3) AS x |> ORDER BY x, p_partkey |> LIMIT 20 |> SELECT p_partkey, x",
        "SELECT p_partkey, p_partkey // nullif(p_size::BIGINT % 3, 0) AS x FROM part ORDER BY x NULLS FIRST, p_partkey LIMIT 20",
    ),
    "order_desc_nulls": (
        "FROM part |> EXTEND 0 / (p_size % 3) AS x |> ORDER BY x DESC, p_partkey DESC |> LIMIT 30 |> SELECT p_partkey, x",
        "SELECT p_partkey, 0::BIGINT // nullif(p_size::BIGINT % 3, 0) AS x FROM part ORDER BY x DESC NULLS LAST, p_partkey DESC LIMIT 30",
    ),
    "topk_multi_key": ("FROM lineitem |> ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber |> LIMIT 25 |> SELECT l_orderkey, l_linenumber, l_extendedprice", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "limit_zero": ("FROM part |> LIMIT 0 |> SELECT p_partkey", "SELECT p_partkey FROM part LIMIT 0"),
    "epoch_minute": (
        "FROM events |> EXTEND ts / 60000000 % 60 AS m |> AGGREGATE count(*) AS n GROUP BY user_id, m |> ORDER BY n DESC, user_id, m |> LIMIT 10",
        "SELECT user_id, epoch_us(ts) // 60000000 % 60 AS m, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id, m LIMIT 10",
    ),
    "metadata_agg": ("FROM lineitem |> AGGREGATE count(*) AS n, min(l_orderkey) AS a, max(l_orderkey) AS b", "SELECT count(*) AS n, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem"),
    "search_phrases": (
        "FROM pages |> WHERE url LIKE '%a%' AND NOT html LIKE '%<script%' |> EXTEND length(html) AS n |> AGGREGATE count(*) AS c, min(url) AS first_url, avg(n) AS mean",
        "SELECT count(*) AS c, min(url) AS first_url, sum(length(html))::DOUBLE / count(*) AS mean FROM pages WHERE url LIKE '%a%' AND NOT html LIKE '%<script%'",
    ),
    "many_keys": (
        "FROM lineitem |> AGGREGATE count(*) AS n, sum(l_suppkey) AS s GROUP BY l_partkey, l_suppkey |> ORDER BY n DESC, l_partkey, l_suppkey |> LIMIT 10",
        "SELECT l_partkey, l_suppkey, count(*) AS n, sum(l_suppkey)::BIGINT AS s FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey, l_suppkey LIMIT 10",
    ),
    "comments": (
        "-- what comes\nFROM nation -- all 'of' them |> LIMIT 0\n |> DROP n_regionkey--\n--",
        "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    ),
    "default_names": (
        "FROM part |> AGGREGATE count(*), COUNT(p_size), sum(P_Size), min(p_name), max(DISTINCT p_brand), count(DISTINCT p_size)",
        'SELECT count(*) AS "count(*)", count(p_size) AS "count(p_size)", sum(p_size)::BIGINT AS "sum(P_Size)", min(p_name) AS "min(p_name)", max(p_brand) AS "max(DISTINCT p_brand)", count(DISTINCT p_size) AS "count(DISTINCT p_size)" FROM part',
    ),
    "where_time": (
        f"FROM events |> WHERE ts >= {_NOON} AND ts < {_NOON + 86_400_000_000} |> SELECT event_id, ts",
        f"SELECT event_id, epoch_us(ts) AS ts FROM events WHERE epoch_us(ts) >= {_NOON} AND epoch_us(ts) < {_NOON + 86_400_000_000}",
    ),
    "where_time_in": (
        "FROM orders |> WHERE o_orderdate IN (907372800000000, 907372800000001, 820454400000000) OR o_orderdate IS NULL OR NOT o_orderdate < 1000000000000000 |> SELECT o_orderkey",
        "SELECT o_orderkey FROM orders WHERE epoch_us(o_orderdate) IN (907372800000000, 907372800000001, 820454400000000) OR o_orderdate IS NULL OR NOT epoch_us(o_orderdate) < 1000000000000000",
    ),
    "metadata_count": ("FROM orders |> EXTEND o_orderkey + 1 AS x |> AGGREGATE count(*) AS n, count(o_custkey) AS c, max(o_orderkey) AS m", "SELECT count(*) AS n, count(o_custkey) AS c, max(o_orderkey) AS m FROM orders"),
    "quarter_choices": (
        "FROM lineitem |> EXTEND l_quantity > 25 AS big |> AGGREGATE count(*) AS n, sum(big) AS m, sum(l_linenumber) AS s GROUP BY l_linestatus AS status, l_returnflag AS flag |> WHERE n > 10 |> EXTEND m * 100 / n AS percent",
        "SELECT l_linestatus AS status, l_returnflag AS flag, count(*) AS n, sum((l_quantity > 25)::BIGINT)::BIGINT AS m, sum(l_linenumber)::BIGINT AS s, sum((l_quantity > 25)::BIGINT)::BIGINT * 100 // count(*) AS percent FROM lineitem GROUP BY ALL HAVING count(*) > 10",
    ),
}
#: Queries that keep rows' order, which DuckDB has by event_id.
ORDERED: dict[str, tuple[str, str]] = {
    "first_seen_groups": ("FROM events |> AGGREGATE count(*) AS n GROUP BY user_id |> LIMIT 9", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 9"),
    "stable_sort": ("FROM events |> ORDER BY event_type DESC |> LIMIT 12 OFFSET 5 |> SELECT event_id", "SELECT event_id FROM events ORDER BY event_type DESC, event_id LIMIT 12 OFFSET 5"),
    "sort_after_sort": ("FROM events |> ORDER BY user_id |> ORDER BY event_type |> LIMIT 40 |> SELECT event_id", "SELECT event_id FROM events ORDER BY event_type, user_id, event_id LIMIT 40"),
    "limit_in_order": ("FROM events |> WHERE event_type = 'view' |> LIMIT 6 OFFSET 3 |> SELECT event_id", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY event_id LIMIT 6 OFFSET 3"),
}
#: Queries over a small table in memory, of what the others lack, and its rows in SQL.
ODD = {
    "k": [1, 2, 3, 4, 5, 6],
    "d": [math.nan, -0.0, None, math.inf, 1.5, -math.inf],
    "s": ["é", "a\\b", "ab\0c", "", None, "x_y"],
    "n": [None, 7, None, -3, 0, 7],
}
ODD_SQL = (
    "(VALUES (1, 'nan'::DOUBLE, 'é', NULL), (2, -0.0::DOUBLE, 'a\\b', 7), (3, NULL, 'ab' || chr(0) || 'c', NULL), (4, 'inf'::DOUBLE, '', -3), "
    "(5, 1.5::DOUBLE, NULL, 0), (6, '-inf'::DOUBLE, 'x_y', 7)) AS v(k, d, s, n)"
)
IN_MEMORY: dict[str, tuple[str, str]] = {
    "values_source": ("FROM odd |> SELECT k, n", f"SELECT k::BIGINT AS k, n::BIGINT AS n FROM {ODD_SQL}"),
    "compare_nan": (
        "FROM odd |> SELECT k, d = d AS a, d != d AS b, d > 0 AS c, d <= 1 AS e",
        f"SELECT k::BIGINT AS k, (NOT isnan(d))::BIGINT AS a, isnan(d)::BIGINT AS b, (NOT isnan(d) AND d > 0)::BIGINT AS c, (NOT isnan(d) AND d <= 1)::BIGINT AS e FROM {ODD_SQL}",
    ),
    "where_nan": ("FROM odd |> WHERE d > 1 |> SELECT k", f"SELECT k::BIGINT AS k FROM {ODD_SQL} WHERE d > 1"),
    "length_nul": ("FROM odd |> SELECT k, length(s) AS n, octet_length(s) AS m", f"SELECT k::BIGINT AS k, CASE WHEN k = 3 THEN 2 ELSE length(s) END::BIGINT AS n, strlen(s)::BIGINT AS m FROM {ODD_SQL}"),
    "like_by_bytes": ("FROM odd |> SELECT k, s LIKE '__' AS two, s LIKE 'a\\b' AS back, s LIKE '%\\%' AS any_back, s LIKE 'x_y' AS one", f"SELECT k::BIGINT AS k, (strlen(s) = 2)::BIGINT AS two, (s = 'a\\b')::BIGINT AS back, contains(s, '\\')::BIGINT AS any_back, (s = 'x_y')::BIGINT AS one FROM {ODD_SQL}"),
    "case_of_numbers": (
        "FROM odd |> SELECT k, CASE WHEN n THEN 'yes' ELSE 'no' END AS a, CASE n WHEN 7 THEN 1 WHEN NULL THEN 2 END AS b, iif(d, 1, 0) AS c",
        f"SELECT k::BIGINT AS k, CASE WHEN n <> 0 THEN 'yes' ELSE 'no' END AS a, CASE WHEN n = 7 THEN 1 END::BIGINT AS b, CASE WHEN d <> 0 THEN 1 ELSE 0 END::BIGINT AS c FROM {ODD_SQL}",
    ),
    "null_groups": ("FROM odd |> AGGREGATE count(*) AS c, count(k) AS m, min(s) AS a, max(s) AS b, sum(DISTINCT k) AS t GROUP BY n", f"SELECT n::BIGINT AS n, count(*) AS c, count(k) AS m, min(s) AS a, max(s) AS b, sum(DISTINCT k)::BIGINT AS t FROM {ODD_SQL} GROUP BY n"),
    "overflow_only_where_kept": ("FROM odd |> WHERE k < 3 |> SELECT k * 3000000000000000000 AS x", f"SELECT k::BIGINT * 3000000000000000000 AS x FROM {ODD_SQL} WHERE k < 3"),
    "custom_function": ("FROM odd |> SELECT k, half(k) AS x, half(n + k) AS y, half(NULL) AS z", f"SELECT k::BIGINT AS k, k / 2.0::DOUBLE AS x, (n + k) / 2.0::DOUBLE AS y, NULL::DOUBLE AS z FROM {ODD_SQL}"),
    "custom_stage": ("FROM odd |> SELECT n |> UNIQUE |> WHERE n IS NOT NULL", f"SELECT DISTINCT n::BIGINT AS n FROM {ODD_SQL} WHERE n IS NOT NULL"),
    "custom_source": ("NUMBERS 12 |> EXTEND number % 5 AS r |> AGGREGATE count(*) AS c GROUP BY r", "SELECT range % 5 AS r, count(*) AS c FROM range(12) GROUP BY r"),
    "catalog_fallback": ("FROM late |> AGGREGATE sum(k) AS s", f"SELECT sum(k)::BIGINT AS s FROM {ODD_SQL}"),
}
#: Queries that are refused: code of the error, where it points (bytes) and its detail.
REFUSED: dict[str, list[tuple[str, int, int, int, int]]] = {
    "refused_grammar": [
        ("FROM nation;", 6, 11, 1, 0),
        ("FROM nation |> LIMIT 3; ", 6, 22, 1, 0),
        ("FROM nation |> SELECT *", 28, 22, 1, 0),
        ("FROM part |> WHERE p_size NOT IN (4, 5)", 6, 26, 3, 0),
        ("FROM part |> WHERE p_size BETWEEN 4 AND 5", 6, 26, 7, 0),
        ("FROM part |> SELECT CAST(p_size AS text) AS t", 7, 32, 2, 6),
        ("FROM part |> WHERE p_name NOT LIKE 'a%'", 6, 26, 3, 0),
        ("FROM part |> WHERE p_size IN ()", 5, 30, 1, 0),
        ("FROM part |> AGGREGATE GROUP BY p_brand", 6, 29, 2, 0),
        ("FROM part |> AGGREGATE count(*) GROUP p_brand", 24, 38, 7, 0),
        ("FROM part |> ORDER p_size", 24, 19, 6, 0),
        ("part |> LIMIT 1", 11, 0, 4, 0),
        ("FROM part |> JOIN nation", 10, 13, 4, 0),
        ("FROM part |> FROM nation", 12, 13, 4, 0),
        ("FROM part WHERE p_size > 1", 6, 10, 5, 0),
        ("FROM part |> SELECT", 5, 19, 0, 0),
        ("FROM part |> RENAME p_size p_width", 21, 27, 7, 0),
        ("FROM part |> SET p_size 3", 7, 24, 1, 15),
        ("FROM part |> SELECT (p_size", 7, 27, 0, 6),
        ("FROM part |> SELECT p_size # 2 AS d", 2, 27, 1, 0),
        ("FROM part |> WHERE p_name = 'it", 3, 28, 3, 0),
        ("FROM part |> SELECT CASE p_size END AS d", 24, 32, 3, 0),
        ("FROM part |> WHERE p_size IS 4", 24, 29, 1, 0),
        ("FROM part |> SELECT " + ", ".join(["p_size"] * 65), 13, 532, 6, 0),
        ("FROM part |> SELECT " + "(" * 70, 8, 84, 1, 0),
    ],
    "refused_conditions": [
        ("FROM part |> WHERE p_retailprice < 1000.25", 16, 35, 7, 4),
        ("FROM part |> WHERE p_size = p_partkey", 16, 28, 9, 2),
        ("FROM part |> WHERE p_size * 2 > 9", 16, 19, 6, 2),
        ("FROM part |> WHERE p_size", 16, 19, 6, 2),
        ("FROM part |> WHERE p_brand = 7", 16, 29, 1, 2),
        ("FROM part |> WHERE p_size > 'large'", 16, 28, 7, 2),
        ("FROM part |> WHERE p_size LIKE '4%'", 16, 19, 6, 2),
        ("FROM part |> WHERE p_retailprice IN (900)", 16, 37, 3, 2),
        ("FROM part |> WHERE p_brand IN ('x', 2)", 16, 36, 1, 2),
        ("FROM part |> WHERE p_retailprice < 9007199254740993", 16, 35, 16, 3),
    ],
    "refused_aggregates": [
        ("FROM part |> AGGREGATE count(DISTINCT *)", 16, 23, 5, 6),
        ("FROM part |> AGGREGATE sum(p_size + 1)", 16, 23, 3, 6),
        ("FROM part |> AGGREGATE sum(p_brand)", 16, 23, 3, 7),
        ("FROM part |> AGGREGATE max(p_retailprice)", 16, 23, 3, 7),
        ("FROM part |> AGGREGATE median(p_size)", 25, 23, 6, 0),
        ("FROM part |> AGGREGATE count(*) GROUP BY p_retailprice", 16, 41, 13, 8),
        ("FROM part |> AGGREGATE count(*) GROUP BY p_size % 2", 16, 41, 6, 8),
        ("FROM part |> AGGREGATE p_size", 16, 23, 6, 6),
        ("FROM part |> ORDER BY p_size + 1", 16, 22, 6, 9),
        ("FROM part |> LIMIT p_size", 16, 19, 6, 5),
        ("FROM part |> LIMIT 1 OFFSET 2, 3", 16, 31, 1, 5),
        ("FROM part |> LIMIT -1", 16, 20, 1, 5),
    ],
    "refused_columns": [
        ("FROM part |> SELECT p_size > 3 OR p_size < 2 AS z", 16, 20, 6, 1),
        ("FROM part |> SELECT p_retailprice * 1.5 AS dear", 16, 36, 3, 4),
        ("FROM part |> EXTEND 99999999999999999999 AS many", 17, 20, 20, 0),
        ("FROM part |> EXTEND iif(p_size > 9, p_size * 2, 0) AS d", 36, 20, 3, 0),
        ("FROM part |> EXTEND coalesce(p_size, p_size + 1) AS d", 36, 20, 8, 0),
        ("FROM part |> EXTEND iif(p_brand, 1, 2) AS d", 35, 20, 3, 0),
        ("FROM part |> EXTEND coalesce(p_size, p_brand) AS d", 34, 20, 8, 0),
        ("FROM part |> EXTEND length(p_size) AS d", 37, 20, 6, 0),
        ("FROM part |> EXTEND ifnull(p_size) AS d", 33, 20, 6, 0),
        ("FROM part |> EXTEND lower(p_brand) AS d", 25, 20, 5, 0),
        ("FROM part |> EXTEND p_brand + 1 AS d", 27, 20, 7, 0),
        ("FROM part |> EXTEND p_retailprice % 7 AS d", 29, 20, 13, 0),
        ("FROM part |> EXTEND p_size = p_brand AS d", 30, 20, 6, 0),
        ("FROM part |> EXTEND p_size < p_retailprice AS d", 31, 20, 6, 0),
        ("FROM part |> EXTEND p_size LIKE 'x' AS d", 32, 20, 6, 0),
        ("FROM part |> EXTEND p_brand LIKE p_name AS d", 16, 33, 6, 1),
        ("FROM part |> EXTEND p_size * 2", 28, 20, 6, 0),
        ("FROM part |> EXTEND count(p_size) AS d", 16, 20, 5, 1),
    ],
    "refused_names": [
        ("FROM parts", 14, 5, 5, 0),
        ("FROM Part", 14, 5, 4, 0),
        ("FROM part |> SELECT p_colour", 15, 20, 8, 0),
        ("FROM part |> DROP p_size, P_SIZE", 22, 26, 6, 0),
        ("FROM part |> RENAME p_size AS a, p_size AS b", 22, 33, 6, 0),
        ("FROM region |> DROP r_name, r_regionkey", 23, 20, 6, 0),
        ("FROM part |> EXTEND p_size AS p_name |> SELECT p_name", 20, 47, 6, 0),
        ("FROM part |> SELECT p_size, p_size |> SELECT P_Size", 20, 45, 6, 0),
    ],
}


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    if spark.conf.get("spark.sql.session.timeZone") not in ("Etc/UTC", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if _LAST["spark"] is not spark or _LAST["folder"] != sf_dir:
        _LAST.update(spark=spark, folder=sf_dir, catalog=Catalog.directory(spark, sf_dir, TABLES))
    return Engine(spark, _LAST["catalog"].copy(), **options)


#: The session and folder last asked for, and its tables: their schemas are looked up once.
_LAST: dict = {"spark": None, "folder": None, "catalog": None}


def _pipe(query: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, **options).sql(query)


def join_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    joined = e.table("orders").join_n1(e.table("customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"])
    return e.then(joined, "WHERE o_totalprice > 100000 |> SELECT o_orderkey, c_name, c_mktsegment").result()


def join_then_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    joined = e.table("lineitem").join_n1(e.table("part"), "l_partkey", "p_partkey", ["p_brand", "p_size"])
    return e.then(joined, "AGGREGATE count(*) AS n, sum(p_size) AS s GROUP BY p_brand").result()


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register("ids", sequence(spark, "id", 10, 1000))
    joined = e.table("ids").join_n1(e.table("customer"), "id", "c_custkey", ["c_nationkey"])
    return e.then(joined, "WHERE id > 11 |> SELECT id, c_nationkey").result()


def _ordered(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, ordered=True).sql(query)


def _unique(compiler, stage) -> None:
    """A stage that leaves one of equal rows."""
    relation = compiler.relation
    compiler.relation = Relation(relation.frame.select(*relation.ids()).distinct(), relation.scope)


def _numbers(compiler, stage) -> None:
    """A source of the numbers below the one it is given."""
    id_ = fresh()
    compiler.relation = Relation(compiler.engine.spark.range(int(stage.parts[0].text)).withColumnRenamed("id", id_), Scope([Column("number", id_, Type.INT64)]))


EXTENDED = STANDARD.with_functions(function("half", (Type.FLOAT64,), Type.FLOAT64, lambda x: x / 2)).with_stages(
    StageRule("UNIQUE", lambda p: (), _unique), StageRule("NUMBERS", lambda p: (p.expression(),), _numbers, source=True)
)


def _in_memory(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        odd = values(spark, ODD)
        return Engine(spark, Catalog({"odd": odd}, fallback=lambda name: odd if name == "late" else None), EXTENDED).sql(query)

    return run


def _refused(queries: list[tuple]) -> Callable[[SparkSession, str], DataFrame]:
    """What the engine says of each query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e, rows = engine(spark, sf_dir), []
        for query, *_ in queries:
            try:
                e.compile(query)
            except QueryError as error:
                rows.append((query, int(error.code), error.span.start, error.span.length, error.detail))
        return spark.createDataFrame(rows, "query string, code long, place long, length long, detail long")

    return run


def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}::BIGINT"


def _rows_sql(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns})"


def order_multi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of one file and the beginning of the next, as listed: orders stands there twice."""
    e = engine(spark, sf_dir, ordered=True)
    n = e.rows("FROM orders |> AGGREGATE count(*) AS n")[0]["n"]
    e.register_parquet("twice", *[f"{sf_dir}/orders.parquet"] * 2)
    return e.sql(f"FROM twice |> LIMIT 7 OFFSET {n - 3} |> SELECT o_orderkey, o_custkey")


def several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.register_parquet("twice", *[f"{sf_dir}/orders.parquet"] * 2)
    return e.sql("FROM twice |> AGGREGATE count(*) AS n, sum(o_orderkey) AS s GROUP BY o_orderstatus")


def relation_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans put together stage by stage, over a DataFrame of any origin."""
    e = engine(spark, sf_dir)
    frame = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select("c_custkey", "c_nationkey", "c_acctbal")
    big = e.then(relation(frame), "WHERE c_custkey > 20 |> EXTEND c_acctbal * 2 AS twice")
    return e.then(big.join_n1(e.table("nation"), "c_nationkey", "n_nationkey", ["n_name"]), "SELECT c_custkey, twice, n_name").result()


def stream_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages as a stream takes them, over a DataFrame that isn't one."""
    return engine(spark, sf_dir).stream(spark.read.parquet(f"{sf_dir}/events.parquet"), "WHERE event_type = 'click' |> EXTEND ts / 1000000 AS second |> SELECT event_id, second")


def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How runs fail: an integer that overflows, a join with a key twice, a file that isn't there any more."""
    e, out = engine(spark, sf_dir), []
    e.register("twice", spark.range(3).selectExpr("id % 2 AS k"))
    joined = e.table("nation").join_n1(e.table("twice"), "n_nationkey", "k")
    runs = {
        "product": lambda: e.rows("FROM part |> SELECT (p_partkey + 10) * 9223372036854775807 AS x"),
        "sum": lambda: e.rows("FROM part |> EXTEND 9223372036854775807 AS x |> AGGREGATE sum(x) AS s"),
        "negated": lambda: e.rows("FROM part |> SELECT -(p_size - p_size - 9223372036854775807 - 1) AS x"),
        "key twice": joined.result().collect,
    }
    for name, run in runs.items():
        try:
            with run_errors():
                run()
        except RunError as error:
            out.append((name, error.failure.value))
    return spark.createDataFrame(out, "run string, failure string")


def error_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes through the compact form and back."""
    rows = []
    for code in Code:
        again = QueryError.parse(QueryError(code, Span(2 * code, code % 5), code % 10).compact())
        rows.append((int(again.code), again.span.start, again.span.length, again.detail, min(1, len(again.message()))))
    return spark.createDataFrame(rows, "code long, place long, length long, detail long, said long")


_MISTAKE = "FROM part\n|> SELECT 'é', zz"


def error_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error with its line, by itself and by the command line tool."""
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        status = explain.main(["sluice:E0015:26+2:0", _MISTAKE])
    rows = [("library", QueryError(Code.UNKNOWN_COLUMN, Span(26, 2)).render(_MISTAKE)), ("tool", shown.getvalue().rstrip("\n")), ("status", str(status)), ("unknown", str(QueryError.parse("sluice:E0099:1+1:0")))]
    return spark.createDataFrame(rows, "form string, text string")


_RENDERED = "error[E0015]: no column here has this name\n --> 2:16\n  |\n2 | |> SELECT 'é', zz\n  |                ^^"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _pipe(pipe) for name, (pipe, _) in PIPES.items()},
    **{name: _ordered(pipe) for name, (pipe, _) in ORDERED.items()},
    **{name: _in_memory(pipe) for name, (pipe, _) in IN_MEMORY.items()},
    **{name: _refused(queries) for name, queries in REFUSED.items()},
    "agg_avg_exact": _pipe(PIPES["agg_avg_exact"][0], wide_averages=True),  # the SQL's products are of 128 bits
    "join_n1": join_n1,
    "join_then_aggregate": join_then_aggregate,
    "sequence_ids": sequence_ids,
    "order_multi_file": order_multi_file,
    "several_files": several_files,
    "relation_api": relation_api,
    "stream_stages": stream_stages,
    "run_failures": run_failures,
    "error_forms": error_forms,
    "error_rendered": error_rendered,
}
ORACLE_SQL: dict[str, str] = {
    **{name: sql for name, (_, sql) in (PIPES | ORDERED | IN_MEMORY).items()},
    **{name: _rows_sql("query, code, place, length, detail", queries) for name, queries in REFUSED.items()},
    "join_n1": "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000",
    "join_then_aggregate": "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "sequence_ids": "SELECT c_custkey AS id, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_custkey > 11 AND c_custkey < 1000",
    "order_multi_file": (
        "WITH twice AS (SELECT 1 AS f, row_number() OVER () AS r, * FROM orders UNION ALL SELECT 2 AS f, row_number() OVER () AS r, * FROM orders) "
        "SELECT o_orderkey, o_custkey FROM twice ORDER BY f, r LIMIT 7 OFFSET (SELECT count(*) - 3 FROM orders)"
    ),
    "several_files": "SELECT o_orderstatus, count(*) * 2 AS n, (sum(o_orderkey) * 2)::BIGINT AS s FROM orders GROUP BY o_orderstatus",
    "relation_api": "SELECT c_custkey, c_acctbal * 2 AS twice, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 AND c_custkey > 20",
    "stream_stages": "SELECT event_id, epoch_us(ts) // 1000000 AS second FROM events WHERE event_type = 'click'",
    "run_failures": _rows_sql("run, failure", [("product", "Overflow"), ("sum", "Overflow"), ("negated", "Overflow"), ("key twice", "Unsupported")]),
    "error_forms": "SELECT i AS code, 2 * i AS place, i % 5 AS length, i % 10 AS detail, 1::BIGINT AS said FROM range(1, 38) AS t(i)",
    "error_rendered": _rows_sql("form, text", [("library", _RENDERED), ("tool", _RENDERED), ("status", "0"), ("unknown", "None")]),
}
