"""One registered query for each operator and function, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import changelog, joins
from tidewater.streaming.dsl import Stream
from tidewater.streaming.engine import Engine

#: Tables and their event times, as streams of the engine.
TABLES = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate", "customer": None, "supplier": None, "part": None, "nation": None, "region": None, "documents": None, "labels": None, "embeddings": None, "pages": None, "benchmark": None, "conversations": None}


#: name: (statement of the dialect, DuckDB SQL)
SQL: dict[str, tuple[str, str]] = {}


def add(name: str, ours: str, oracle: str) -> None:
    SQL[name] = (ours, oracle)


# scalar functions: math, scaled to integers where the last bits of libraries differ
def _scaled(name: str, x: str, duck: str | None = None, table: str = "lineitem", keys: str = "l_orderkey, l_linenumber") -> None:
    d = (duck or name).lower()
    add(f"math_{name.lower()}", f"SELECT {keys}, ROUND({name}({x}) * 1000000) AS y FROM {table};", f"SELECT {keys}, CAST(round_even({d}({x}) * 1000000, 0) AS BIGINT) AS y FROM {table}")


for _f in ("SIN", "COS", "TAN", "ATAN", "ASINH"):
    _scaled(_f, "l_quantity")
for _f in ("SINH", "COSH", "TANH", "EXP", "ATANH"):
    _scaled(_f, "l_discount")
for _f in ("ASIN", "ACOS"):
    _scaled(_f, "l_tax")
_scaled("ACOSH", "l_quantity")
_scaled("SQRT", "l_extendedprice")
_scaled("LOG", "l_extendedprice", "ln")
_scaled("LOG2", "l_extendedprice")
_scaled("LOG10", "l_extendedprice")
add("math_abs", "SELECT c_custkey, ABS(c_acctbal) AS y FROM customer;", "SELECT c_custkey, abs(c_acctbal) AS y FROM customer")
add("math_ceil", "SELECT c_custkey, CEIL(c_acctbal) AS y FROM customer;", "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS y FROM customer")
add("math_floor", "SELECT c_custkey, FLOOR(c_acctbal) AS y FROM customer;", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS y FROM customer")
add("math_round", "SELECT c_custkey, ROUND(c_acctbal * 0.5) AS y FROM customer;", "SELECT c_custkey, CAST(round_even(c_acctbal * 0.5, 0) AS BIGINT) AS y FROM customer")
add("math_sign", "SELECT c_custkey, SIGN(c_acctbal) AS y FROM customer;", "SELECT c_custkey, CAST(sign(c_acctbal) AS BIGINT) AS y FROM customer")
add("math_domain", "SELECT l_orderkey, l_linenumber, ASIN(l_quantity) AS a, ACOSH(l_discount) AS b, LOG(l_discount - 1.0) AS c, ATANH(l_quantity) AS d FROM lineitem WHERE l_quantity > 1;", "SELECT l_orderkey, l_linenumber, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c, NULL::DOUBLE AS d FROM lineitem WHERE l_quantity > 1")
add("arithmetic", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * 2 AS c, l_quantity * l_discount AS d FROM lineitem;", "SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * 2 AS c, l_quantity * l_discount AS d FROM lineitem")

# type tests, nulls, conversions
add("type_tests", "SELECT event_id, IS_INT(user_id) AS i, IS_FLOAT(value) AS f, IS_NUM(value) AS n, IS_BOOL(value > 1) AS b, IS_STR(event_type) AS s, IS_ARRAY({user_id}) AS a, IS_DATE(ts) AS d, IS_TIME(ts) AS t FROM events;", "SELECT event_id, true AS i, true AS f, true AS n, true AS b, true AS s, true AS a, false AS d, false AS t FROM events")
add("type_tests_json", "SELECT event_id, IS_INT(props -> 'k') AS i, IS_STR(props -> 'k') AS s, IS_NUM(props -> 'none') AS n FROM events;", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS i, false AS s, false AS n FROM events")
add("to_str", "SELECT event_id, TO_STR(user_id) AS y FROM events;", "SELECT event_id, CAST(user_id AS VARCHAR) AS y FROM events")
add("ifnull", "SELECT event_id, IFNULL(NULLIF(user_id, 3), 0 - 1) AS y FROM events;", "SELECT event_id, coalesce(nullif(user_id, 3), -1) AS y FROM events")
add("nullif", "SELECT event_id, NULLIF(event_type, 'click') AS y FROM events;", "SELECT event_id, nullif(event_type, 'click') AS y FROM events")
add("cast_float_to_integer", "SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS y FROM customer;", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS y FROM customer")
add("cast_text", "SELECT event_id, event_type :: INTEGER AS a, CAST(user_id AS STRING) :: INTEGER AS b, '1.5' :: INTEGER AS c, 'T' :: BOOLEAN AS d, '2.0' :: BOOLEAN AS e, '2024-01-02' :: DATE AS f FROM events;", "SELECT event_id, NULL::BIGINT AS a, user_id AS b, NULL::BIGINT AS c, true AS d, true AS e, DATE '2024-01-02' AS f FROM events")

# strings
_P = "SELECT p_partkey, {} AS y FROM part"


def _text(name: str, ours: str, duck: str) -> None:
    add(f"text_{name}", _P.format(ours) + ";", _P.format(duck))


_text("to_lower", "TO_LOWER(p_name)", "lower(p_name)")
_text("to_upper", "TO_UPPER(p_name)", "upper(p_name)")
_text("reverse", "REVERSE(p_name)", "reverse(p_name)")
_text("strlen", "STRLEN(p_name)", "length(p_name)")
_text("take", "TAKE(3, p_name)", "left(p_name, 3)")
_text("takeend", "TAKEEND(3, p_name)", "right(p_name, 3)")
_text("drop", "DROP(3, p_name)", "substring(p_name, 4)")
_text("dropend", "DROPEND(3, p_name)", "left(p_name, greatest(length(p_name) - 3, 0))")
_text("split", "ARRAY_JOIN(SPLIT(' ', p_name), '|')", "array_to_string(string_split(p_name, ' '), '|')")
_text("chunksof", "ARRAY_JOIN(CHUNKSOF(3, p_name), '|')", "array_to_string(list_transform(range(0, length(p_name), 3), lambda i: substring(p_name, CAST(i AS BIGINT) + 1, 3)), '|')")
for _n, _f, _d in (("trim", "TRIM", "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"), ("left_trim", "LEFT_TRIM", "regexp_replace(text, '^\\s+', '')"), ("right_trim", "RIGHT_TRIM", "regexp_replace(text, '\\s+$', '')")):
    add(f"text_{_n}", f"SELECT doc_id, {_f}(text) AS y FROM documents;", f"SELECT doc_id, {_d} AS y FROM documents")

# dates
add("datetostring", "SELECT event_id, DATETOSTRING(event_id * 3600, '%Y-%m-%d %H:%M:%S') AS y FROM events;", "SELECT event_id, strftime(make_timestamp(event_id * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') AS y FROM events")
add("datetostring_web", "SELECT event_id, DATETOSTRING(event_id * 3600, '%a, %d %b %Y %H:%M:%S GMT') AS y FROM events;", "SELECT event_id, strftime(make_timestamp(event_id * 3600 * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS y FROM events")
add("stringtodate", "SELECT event_id, STRINGTODATE(DATETOSTRING(event_id * 60, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS y FROM events;", "SELECT event_id, event_id * 60 AS y FROM events")
add("date_literals", "SELECT event_id, DATE '2021-08-07' AS a, ts > TIMESTAMP '2024-01-10T00:00:00+00:00' AS b FROM events;", "SELECT event_id, DATE '2021-08-07' AS a, ts > TIMESTAMP '2024-01-10' AS b FROM events")

# arrays, printed so that both engines give plain text
_A, _DA = "{l_linenumber, l_linenumber, 3, l_orderkey}", "[l_linenumber::BIGINT, l_linenumber::BIGINT, 3, l_orderkey]"


def _array(name: str, ours: str, duck: str) -> None:
    add(f"array_{name}", f"SELECT l_orderkey, l_linenumber, {ours} AS y FROM lineitem;", f"SELECT l_orderkey, l_linenumber, {duck} AS y FROM lineitem")


def _listed(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v: CAST(v AS VARCHAR)), ',')"


_array("constructor", f"ARRAY_JOIN({_A})", _listed(_DA))
_array("contain", f"ARRAY_CONTAIN({_A}, 3)", f"list_contains({_DA}, 3)")
_array("distinct", f"ARRAY_JOIN(ARRAY_SORT(ARRAY_DISTINCT({_A})))", _listed(f"list_sort(list_distinct({_DA}))"))
_array("except", f"ARRAY_JOIN(ARRAY_SORT(ARRAY_EXCEPT({_A}, {{3}})))", _listed(f"list_sort(list_distinct(list_filter({_DA}, lambda v: v <> 3)))"))
_array("intersect", f"ARRAY_JOIN(ARRAY_INTERSECT({_A}, {{3}}))", _listed(f"list_distinct(list_filter({_DA}, lambda v: v = 3))"))
_array("length", f"ARRAY_LENGTH({_A})", f"CAST(len({_DA}) AS BIGINT)")
_array("remove", f"ARRAY_JOIN(ARRAY_REMOVE({_A}, 3))", _listed(f"list_filter({_DA}, lambda v: v <> 3)"))
_array("union", f"ARRAY_JOIN(ARRAY_SORT(ARRAY_UNION({_A}, {{9, 3}})))", _listed(f"list_sort(list_distinct(list_concat({_DA}, [9, 3])))"))
_array("join", f"ARRAY_JOIN({_A}, ' / ')", f"array_to_string(list_transform({_DA}, lambda v: CAST(v AS VARCHAR)), ' / ')")
_array("max", f"ARRAY_MAX({_A})", f"list_max({_DA})")
_array("min", f"ARRAY_MIN({_A})", f"list_min({_DA})")
_array("sort", f"ARRAY_JOIN(ARRAY_SORT({_A}))", _listed(f"list_sort({_DA})"))
_array("index", f"({_A})[3]", f"({_DA})[4]")
_array("slice", f"ARRAY_JOIN(({_A})[1:2])", _listed(f"list_slice({_DA}, 2, 3)"))
_array("slice_from", f"ARRAY_JOIN(({_A})[2:])", _listed(f"list_slice({_DA}, 3, 4)"))
_array("slice_to", f"ARRAY_JOIN(({_A})[:1])", _listed(f"list_slice({_DA}, 1, 2)"))
add("array_embedding", "SELECT vec_id, ARRAY_LENGTH(embedding) AS n, ARRAY_MAX(embedding) AS hi, ARRAY_MIN(embedding) AS lo FROM embeddings;", "SELECT vec_id, len(embedding) AS n, list_max(embedding) AS hi, list_min(embedding) AS lo FROM embeddings")

# JSON
add("json_field", "SELECT event_id, (props -> 'k') :: INTEGER AS y FROM events;", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y FROM events")
add("json_text", "SELECT event_id, props ->> 'k' AS y, props ->> 'none' AS z FROM events;", "SELECT event_id, json_extract_string(props, '$.k') AS y, NULL::VARCHAR AS z FROM events")
add("json_path", "SELECT event_id, (props #> {'k'}) :: INTEGER AS y FROM events;", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS y FROM events")
add("json_path_text", "SELECT event_id, props #>> {'k'} AS y FROM events;", "SELECT event_id, json_extract_string(props, '$.k') AS y FROM events")

# projection, predicates
add("project_all", "SELECT * FROM nation;", "SELECT * FROM nation")
add("project_alias", "SELECT n.n_name AS name, n.n_nationkey FROM nation AS n;", "SELECT n_name AS name, n_nationkey FROM nation")
add("project_qualified_star", "SELECT n.* FROM nation AS n;", "SELECT * FROM nation")
add("derived_table", "SELECT d.b AS b, d.a AS a FROM (SELECT n_name AS a, n_nationkey * 2 AS b FROM nation) AS d WHERE d.b > 10;", "SELECT n_nationkey::BIGINT * 2 AS b, n_name AS a FROM nation WHERE n_nationkey * 2 > 10")
add("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag <> 'A' OR l_discount = 0.05;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag <> 'A' OR l_discount = 0.05")
add("filter_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 10;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_quantity > 10")
add("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
add("filter_not_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20")
add("filter_between_symmetric", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN SYMMETRIC 20 AND 10;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
add("filter_not_between_symmetric", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN SYMMETRIC 20 AND 10;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 20")

# aggregates
_G = "FROM lineitem GROUP BY l_returnflag, l_linestatus"
add("agg_count", f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 1)) AS m {_G};", f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(nullif(l_linenumber, 1)) AS m {_G}")
add("agg_sum_avg_min_max", f"SELECT l_returnflag, l_linestatus, SUM(l_partkey) AS s, MAX(l_partkey) AS hi, MIN(l_extendedprice) AS lo, AVG(l_linenumber) AS a {_G};", f"SELECT l_returnflag, l_linestatus, CAST(sum(l_partkey) AS BIGINT) AS s, max(l_partkey) AS hi, min(l_extendedprice) AS lo, avg(l_linenumber) AS a {_G}")
add("agg_global", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s FROM orders;", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
add("agg_expression", f"SELECT l_returnflag, l_linestatus, SUM(l_partkey) + MAX(l_suppkey) * 2 AS y {_G};", f"SELECT l_returnflag, l_linestatus, CAST(sum(l_partkey) AS BIGINT) + max(l_suppkey) * 2 AS y {_G}")
add("agg_having", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 10 AND MAX(l_quantity) > 45;", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10 AND max(l_quantity) > 45")
add("agg_topk", "SELECT o_custkey, ARRAY_JOIN(t) AS top FROM (SELECT o_custkey, TOPK(o_orderkey, 3) AS t FROM orders GROUP BY o_custkey);", f"SELECT o_custkey, {_listed("list_slice(list_sort(list(o_orderkey), 'DESC'), 1, 3)")} AS top FROM orders GROUP BY o_custkey")
add("agg_topkdistinct", "SELECT l_suppkey, n, ARRAY_JOIN(t) AS top FROM (SELECT l_suppkey, COUNT(*) AS n, TOPKDISTINCT(l_linenumber, 2) AS t FROM lineitem GROUP BY l_suppkey);", f"SELECT l_suppkey, count(*) AS n, {_listed("list_slice(list_sort(list(DISTINCT l_linenumber), 'DESC'), 1, 2)")} AS top FROM lineitem GROUP BY l_suppkey")

# joins
_O = "o_orderkey, o_custkey, c_custkey, c_nationkey"
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    add(f"join_{_how.lower()}", f"SELECT {_O} FROM orders {_how} JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000;", f"SELECT {_O} FROM orders {_how} JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation;", "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey;", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
add("join_natural", "SELECT a.name AS name, b.region AS region FROM (SELECT n_name AS name, n_regionkey AS k FROM nation) AS a NATURAL JOIN (SELECT r_name AS region, r_regionkey AS k FROM region) AS b;", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
add("join_using", "SELECT a.name AS name, b.region AS region FROM (SELECT n_name AS name, n_regionkey AS k FROM nation) AS a LEFT JOIN (SELECT r_name AS region, r_regionkey AS k FROM region WHERE r_regionkey < 3) AS b USING (k);", "SELECT n_name AS name, r_name AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
add("join_multiway", "SELECT o_orderkey, n_name, r_name FROM orders INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey INNER JOIN region ON n_regionkey = r_regionkey;", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("join_group", "SELECT n_name, COUNT(*) AS n, SUM(o_orderkey) AS s FROM orders INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name;", "SELECT n_name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_E1 = "(SELECT event_id AS a, user_id AS u, ts FROM events WHERE event_type = 'click')"
_E2 = "(SELECT event_id AS b, user_id AS v, ts FROM events WHERE event_type = 'purchase')"
for _how in ("INNER", "LEFT", "RIGHT", "FULL"):
    add(f"join_within_{_how.lower()}", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x {_how} JOIN {_E2} AS y ON x.u = y.v WITHIN (INTERVAL 6 HOUR);", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x {_how} JOIN {_E2} AS y ON x.u = y.v AND y.ts BETWEEN x.ts - INTERVAL 6 HOUR AND x.ts + INTERVAL 6 HOUR")
add("join_within_theta", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x INNER JOIN {_E2} AS y ON x.u < y.v WITHIN (INTERVAL 10 MINUTE);", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x JOIN {_E2} AS y ON x.u < y.v AND y.ts BETWEEN x.ts - INTERVAL 10 MINUTE AND x.ts + INTERVAL 10 MINUTE")
add("join_within_cross", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x CROSS JOIN {_E2} AS y WITHIN (INTERVAL 10 MINUTE);", f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x JOIN {_E2} AS y ON y.ts BETWEEN x.ts - INTERVAL 10 MINUTE AND x.ts + INTERVAL 10 MINUTE")

# windows
_B = "time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')"
add("tumbling_count", "SELECT event_type, COUNT(*) AS cnt, SUM(event_id) AS s FROM TUMBLE(events, INTERVAL 1 HOUR) GROUP BY event_type;", f"SELECT event_type, count(*) AS cnt, CAST(sum(event_id) AS BIGINT) AS s, {_B} AS window_start, {_B} + INTERVAL 1 HOUR AS window_end FROM events GROUP BY event_type, {_B}")
add("window_having", "SELECT event_type, COUNT(*) AS cnt FROM TUMBLE(events, INTERVAL 1 DAY) GROUP BY event_type HAVING COUNT(*) > 5;", "SELECT event_type, count(*) AS cnt, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end FROM events GROUP BY 1, 3, 4 HAVING count(*) > 5")
add("hopping_count", "SELECT event_type, COUNT(*) AS cnt FROM HOP(events, INTERVAL 2 HOUR, INTERVAL 30 MINUTE) GROUP BY event_type;", "SELECT event_type, count(*) AS cnt, w AS window_start, w + INTERVAL 2 HOUR AS window_end FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 90 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), INTERVAL 30 MINUTE)) AS w FROM events) GROUP BY event_type, w")
add("session_count", "SELECT user_id, COUNT(*) AS cnt FROM SESSION(events, INTERVAL 6 HOUR) GROUP BY user_id;", "SELECT user_id, count(*) AS cnt, min(ts) AS window_start, max(ts) AS window_end FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_id, g")
add("sliding_sum", "SELECT event_type, SUM(event_id) AS s, COUNT(*) AS n FROM SLIDING(events, INTERVAL 1 HOUR) GROUP BY event_type;", "SELECT event_type, CAST(sum(event_id) OVER w AS BIGINT) AS s, count(*) OVER w AS n, ts - INTERVAL 1 HOUR AS window_start, ts AS window_end FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
add("window_topk", "SELECT event_type, ARRAY_JOIN(t) AS top, window_start, window_end FROM (SELECT event_type, TOPK(event_id, 2) AS t FROM TUMBLE(events, INTERVAL 6 HOUR) GROUP BY event_type);", f"SELECT event_type, {_listed("list_slice(list_sort(list(event_id), 'DESC'), 1, 2)")} AS top, w AS window_start, w + INTERVAL 6 HOUR AS window_end FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events) GROUP BY event_type, w")

add("window_topk_hop", "SELECT event_type, ARRAY_JOIN(t) AS top, window_start, window_end FROM (SELECT event_type, TOPK(event_id, 2) AS t FROM HOP(events, INTERVAL 2 HOUR, INTERVAL 1 HOUR) GROUP BY event_type);", f"SELECT event_type, {_listed("list_slice(list_sort(list(event_id), 'DESC'), 1, 2)")} AS top, w AS window_start, w + INTERVAL 2 HOUR AS window_end FROM (SELECT event_type, event_id, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')]) AS w FROM events) GROUP BY event_type, w")

#: Queries through the frame API: name: (function, DuckDB SQL)
FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return joins.latest(orders, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderdate")


def table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-table join: each event with its user's last event, as the table stands when all is read."""
    events = _table(spark, sf_dir, "events")
    last = joins.latest(events.select("user_id", "ts", "event_id"), ["user_id"], "ts").select("user_id", F.col("event_id").alias("last_id"))
    return events.select("event_id", "user_id").join(last, "user_id").select("event_id", "user_id", "last_id")


def changelog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = changelog.changes(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))
    b = changelog.changes(_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))
    return changelog.join(changelog.consolidate(a), changelog.consolidate(b), ["k"]).select("k", F.col("_diff").alias("n"))


def changelog_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog.changes(_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag"))
    gone = changelog.changes(_table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_suppkey", "l_returnflag"), -1)
    return changelog.distinct(changelog.union(log, gone)).drop("_diff")


def changelog_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retractions and additions of a count when one order status leaves."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    before = changelog.reduce(changelog.changes(orders), ["o_custkey"], n=F.count("*"))
    after = changelog.reduce(changelog.changes(orders.where("o_orderstatus <> 'F'")), ["o_custkey"], n=F.count("*"))
    return changelog.difference(after, before).select("o_custkey", "n", F.col("_diff").alias("diff"))


def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer, supplier and nation belongs to, over any number of steps."""
    link = lambda t, a, x, b, y: _table(spark, sf_dir, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    edges = link("customer", "c", "c_custkey", "n", "c_nationkey").unionByName(link("supplier", "s", "s_suppkey", "n", "s_nationkey")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    return changelog.reachability(edges)


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = changelog.changes(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))
    r = changelog.changes(_table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return changelog.rows(changelog.union(n, r))


def as_of_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.as_of(events, 3_600_000_000, ["user_id"], "ts", {"n": lambda f: f.count("*")}).select("event_id", "user_id", "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship as a continuous query into a view, run until its input ends."""
    e = Engine(spark, lateness="400 days")
    e.register("events", f"{sf_dir}/events.parquet", "ts")
    q = e.execute("CREATE VIEW counts AS SELECT event_type, COUNT(*) AS cnt, SUM(event_id) AS s FROM TUMBLE(events, INTERVAL 1 HOUR) GROUP BY event_type;")
    e.wait(q)
    return e.sql("SELECT event_type, cnt, s, window_start, window_end FROM counts;").select("event_type", "cnt", "s", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")])


def _two_kinds(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks and purchases of users."""
    pick = lambda kind, name, ts: df.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(ts))
    return pick("click", "a", "ta"), pick("purchase", "b", "tb")


def known_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with its user's last purchase before it."""
    clicks, purchases = _two_kinds(_table(spark, sf_dir, "events"))
    return joins.lookup(clicks, purchases, ["user_id"], "ta", "tb").select("a", "b")


def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of two unbounded streams."""
    e = _opened(spark, sf_dir, "events")
    clicks, purchases = _two_kinds(e._open_stream("events")[0])
    joined = Stream(clicks, "ta").join_changes(Stream(purchases, "tb"), ["user_id"])
    joined.to("parquet", path=f"{e.root}/lookup", checkpointLocation=f"{e.root}/lookup-checkpoint").awaitTermination()
    return spark.read.schema(joined.df.schema).parquet(f"{e.root}/lookup").select("a", "b")


def valid_for_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type count at a frontier, each being valid for six hours."""
    log = changelog.for_interval(_table(spark, sf_dir, "events").select("event_type", "ts"), "ts", F.expr("INTERVAL 6 HOURS")).drop("ts")
    return changelog.advance(log, F.lit(_FRONTIER).cast("timestamp_ntz")).select("event_type", F.col("_diff").alias("n"))


def valid_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open hopping windows at a frontier: what has come, of windows that haven't ended."""
    log = changelog.for_window(_table(spark, sf_dir, "events").select("event_type", "ts"), "ts", "2 days", "1 day").drop("ts")
    return changelog.advance(log, F.lit(_FRONTIER).cast("timestamp_ntz")).select("event_type", "window_start", F.col("_diff").alias("n"))


def frontier_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much the counts change while the frontier moves by a day."""
    log = changelog.for_interval(_table(spark, sf_dir, "events").select("event_type", "ts"), "ts", F.expr("INTERVAL 6 HOURS")).drop("ts")
    to = F.lit(_FRONTIER).cast("timestamp_ntz")
    return changelog.between(log, to - F.expr("INTERVAL 1 DAY"), to).select("event_type", F.col("_diff").alias("n"))


_FRONTIER = "2024-01-15 12:00:00"


def _opened(spark: SparkSession, sf_dir: str, *tables: str, lateness: str = "400 days") -> Engine:
    e = Engine(spark, lateness=lateness)
    for t in tables:
        e.register(t, f"{sf_dir}/{t}.parquet", TABLES[t])
    return e


def _pushed(statement: str, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A continuous query, run until its input ends: what it has emitted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _opened(spark, sf_dir, *[t for t in TABLES if t in statement])
        q = e.execute(statement)
        e.wait(q)
        return _plain(e.changes(q)).select(*columns)

    return run


def _viewed(statement: str, columns: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    """A continuous query into the view v, run until its input ends: the view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _opened(spark, sf_dir, *[t for t in TABLES if t in statement])
        e.wait(e.execute(f"CREATE VIEW v AS {statement};"))
        return _plain(e.sql("SELECT * FROM v;")).select(*columns)

    return run


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


def _outer(how: str) -> Callable[[SparkSession, str], DataFrame]:
    """An outer join of streams within six hours: the part that no later row can change."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _opened(spark, sf_dir, "events", lateness="0 seconds")
        q = e.execute(f"SELECT x.a AS a, y.b AS b, x.ts AS ta, y.ts AS tb FROM {_E1} AS x {how} JOIN {_E2} AS y ON x.u = y.v WITHIN (INTERVAL 6 HOUR) EMIT CHANGES;")
        e.wait(q)
        end = _table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).first()[0]
        return e.changes(q).where(F.coalesce("ta", "tb") < F.lit(end) - F.expr("INTERVAL 12 HOURS")).select("a", "b")

    return run


def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived stream, and rows of it inserted into another, read from a time on."""
    e = _opened(spark, sf_dir, "events")
    e.wait(e.execute("CREATE STREAM large AS SELECT event_id, user_id, ts FROM events WHERE value > 50;"))
    e.execute("CREATE STREAM kept (event_id INTEGER, user_id INTEGER, ts TIMESTAMP);")
    e.wait(e.execute("INSERT INTO kept SELECT event_id, user_id, ts FROM large WHERE user_id > 10;"))
    return e.sql(f"SELECT event_id, user_id FROM kept WHERE ts >= TIMESTAMP '{_FRONTIER.replace(' ', 'T')}+00:00';")


def stream_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded read of a stream by time, both ends included, and by key."""
    e = _opened(spark, sf_dir, "events")
    return e.read_range("events", "2024-01-10 00:00:00", _FRONTIER, {"user_id": 7}).select("event_id", "event_type")


_PURCHASES_BEFORE = "SELECT c.event_id AS a, p.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts"
_T = f"TIMESTAMP '{_FRONTIER}'"
FRAMES["lookup_as_known"] = (known_lookup, _PURCHASES_BEFORE)
FRAMES["stream_lookup_as_known"] = (stream_lookup, _PURCHASES_BEFORE)
FRAMES["changelog_sliding"] = (valid_for_hours, f"SELECT event_type, count(*) AS n FROM events WHERE ts <= {_T} AND ts + INTERVAL 6 HOUR > {_T} GROUP BY 1")
FRAMES["changelog_hopping"] = (valid_in_windows, f"SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT event_type, ts, unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)])::TIMESTAMP AS w FROM events) WHERE ts <= {_T} AND w + INTERVAL 2 DAY > {_T} GROUP BY 1, 2")
FRAMES["changelog_frontier"] = (frontier_moves, f"WITH s AS (SELECT event_type, sum((ts <= {_T} AND ts + INTERVAL 6 HOUR > {_T})::INT) - sum((ts <= {_T} - INTERVAL 1 DAY AND ts + INTERVAL 6 HOUR > {_T} - INTERVAL 1 DAY)::INT) AS n FROM events GROUP BY 1) SELECT event_type, n::BIGINT AS n FROM s WHERE n <> 0")
FRAMES["stream_sliding"] = (_pushed("SELECT event_type, SUM(event_id) AS s, COUNT(*) AS n FROM SLIDING(events, INTERVAL 1 HOUR) GROUP BY event_type EMIT CHANGES;", ["event_type", "s", "n", "window_start", "window_end"]), SQL["sliding_sum"][1])
FRAMES["stream_hopping_view"] = (_viewed("SELECT event_type, COUNT(*) AS cnt FROM HOP(events, INTERVAL 2 HOUR, INTERVAL 30 MINUTE) GROUP BY event_type", ["event_type", "cnt", "window_start", "window_end"]), SQL["hopping_count"][1])
FRAMES["stream_session_view"] = (_viewed("SELECT user_id, COUNT(*) AS cnt FROM SESSION(events, INTERVAL 6 HOUR) GROUP BY user_id", ["user_id", "cnt", "window_start", "window_end"]), SQL["session_count"][1])
FRAMES["stream_group_view"] = (_viewed("SELECT user_id, COUNT(*) AS n, SUM(event_id) AS s, MAX(event_id) AS hi, MIN(event_id) AS lo FROM events GROUP BY user_id", ["user_id", "n", "s", "hi", "lo"]), "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s, max(event_id) AS hi, min(event_id) AS lo FROM events GROUP BY 1")
FRAMES["stream_filter_push"] = (_pushed("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 10 EMIT CHANGES;", ["event_id", "user_id"]), "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 10")
FRAMES["stream_join_push"] = (_pushed(f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x INNER JOIN {_E2} AS y ON x.u = y.v WITHIN (INTERVAL 6 HOUR) EMIT CHANGES;", ["a", "b"]), SQL["join_within_inner"][1])
FRAMES["stream_join_group_view"] = (_viewed(f"SELECT x.u AS u, COUNT(*) AS n FROM {_E1} AS x INNER JOIN {_E2} AS y ON x.u = y.v WITHIN (INTERVAL 6 HOUR) GROUP BY x.u", ["u", "n"]), f"SELECT u, count(*) AS n FROM {_E1} x JOIN {_E2} y ON x.u = y.v AND y.ts BETWEEN x.ts - INTERVAL 6 HOUR AND x.ts + INTERVAL 6 HOUR GROUP BY u")
for _how in ("LEFT", "RIGHT", "FULL"):
    FRAMES[f"stream_join_{_how.lower()}"] = (_outer(_how), f"SELECT x.a AS a, y.b AS b FROM {_E1} AS x {_how} JOIN {_E2} AS y ON x.u = y.v AND y.ts BETWEEN x.ts - INTERVAL 6 HOUR AND x.ts + INTERVAL 6 HOUR WHERE coalesce(x.ts, y.ts) < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR")
FRAMES["stream_chain"] = (stream_chain, f"SELECT event_id, user_id FROM events WHERE value > 50 AND user_id > 10 AND ts >= {_T}")
FRAMES["stream_range"] = (stream_range, f"SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND {_T} AND user_id = 7")
FRAMES["latest_by_key"] = (latest_order, "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
FRAMES["stream_table_join"] = (table_lookup, "SELECT e.event_id, e.user_id, l.last_id FROM events e JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1) l USING (user_id)")
FRAMES["changelog_join"] = (changelog_join, "SELECT c_nationkey AS k, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
FRAMES["changelog_distinct"] = (changelog_distinct, "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'A'")
FRAMES["changelog_reduce"] = (changelog_reduce, "WITH b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT * FROM (SELECT o_custkey, n, 1::BIGINT AS diff FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, n, -1::BIGINT AS diff FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
FRAMES["reachability"] = (reachable, "WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
FRAMES["union_all"] = (union_all, "SELECT n_name AS name FROM nation UNION ALL SELECT r_name AS name FROM region")
FRAMES["as_of_count"] = (as_of_sum, "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
FRAMES["stream_tumbling_view"] = (stream_tumbling, SQL["tumbling_count"][1])


def _run(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in statement]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)  # registers folders only; rows are read by the plan
        for t in used:
            e.register(t, f"{sf_dir}/{t}.parquet", TABLES[t])
        return e.sql(statement)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{k: _run(v[0]) for k, v in SQL.items()}, **{k: v[0] for k, v in FRAMES.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: v[1] for k, v in SQL.items()}, **{k: v[1] for k, v in FRAMES.items()}}
