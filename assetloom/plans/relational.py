"""Queries of the general SQL surface over the driver's tables.

The reference hands any SELECT to an embedded database; these cover what that offers, category by
category, and some of what Spark offers beyond.  Text is shared with DuckDB where the dialects agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adhoc import DRIVER_TABLES, query, register

_MONEY = "CAST({} AS DECIMAL(18,2))"


def _sum(column: str, name: str) -> str:
    return f"CAST(sum({_MONEY.format(column)}) AS DOUBLE) AS {name}"


#: name -> text for both engines, or (Spark's, DuckDB's)
TEXTS: dict[str, str | tuple[str, str]] = {
    "sql_join_inner": f"SELECT c_mktsegment, count(*) AS n, {_sum('o_totalprice', 'total')} FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment",
    "sql_join_multi": f"SELECT n_name, r_name, {_sum('l_extendedprice', 'revenue')} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority LIKE '1%' GROUP BY c_custkey",
    "sql_join_right": "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k = b.k",
    "sql_join_natural": "SELECT r_name, count(*) AS n FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x GROUP BY r_name",
    "sql_join_using": "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_totalprice > 100000) o USING (l_orderkey) GROUP BY l_returnflag",
    "sql_join_cross": "SELECT a.r_name AS one, b.r_name AS other FROM region a CROSS JOIN region b",
    "sql_join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_join_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey IS NOT NULL)",
    "sql_join_theta": "SELECT a.n_name AS low, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sql_agg_basic": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_sum('l_quantity', 'quantity')}, {_sum('l_extendedprice', 'price')}, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_agg_having": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5",
    "sql_agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "sql_agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type",
    "sql_agg_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_agg_rollup": "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_agg_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_window_rank": "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "sql_window_share": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS cd FROM customer",
    "sql_window_frame": f"SELECT user_id, event_id, CAST(sum({_MONEY.format('value')}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3 FROM events",
    "sql_window_lag": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "sql_setops": "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier EXCEPT SELECT r_regionkey FROM region",
    "sql_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_offset": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40",
    "sql_order_nulls": "SELECT v FROM (SELECT nullif(n_regionkey, 2) AS v, n_nationkey FROM nation) x ORDER BY v NULLS FIRST, n_nationkey LIMIT 8",
    "sql_cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t",
    "sql_values": ("SELECT col1 AS a, col2 AS b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)"),
    "sql_case_between": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'odd' ELSE 'large' END AS size_class FROM part",
    "sql_string": "SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, length(c_name) AS n, replace(c_name, '#', '-') AS plain, trim(c_mktsegment) || '!' AS seg, instr(c_name, '#') AS at FROM customer",
    "sql_like": ("SELECT p_partkey FROM part WHERE p_type ILIKE '%promo%' AND p_brand RLIKE '^Brand#[12]'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%promo%' AND regexp_matches(p_brand, '^Brand#[12]')"),
    "sql_date": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS month, year(o_orderdate) AS y, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days FROM orders"),
    "sql_math": ("SELECT p_partkey, abs(p_size - 25) AS d, round(p_retailprice, 1) AS r, p_size div 7 AS q, p_size % 7 AS m, greatest(p_size, 20) AS g, try_divide(p_size, p_size % 2) AS t FROM part", "SELECT p_partkey, abs(p_size - 25) AS d, round(p_retailprice, 1) AS r, CAST(p_size // 7 AS BIGINT) AS q, p_size % 7 AS m, greatest(p_size, 20) AS g, CASE WHEN p_size % 2 <> 0 THEN CAST(p_size AS DOUBLE) / (p_size % 2) END AS t FROM part"),
    "sql_json": ("SELECT event_id, json_array_length(concat('[', props, ']')) AS n, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, CAST(json_array_length('[' || props || ']') AS INTEGER) AS n, json_extract_string(props, '$.k') AS k FROM events"),
    "sql_glob": "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '[a-m]* [!-~]*t' AND NOT p_brand GLOB 'Brand#1?' AND p_type <> 'x GLOB ''y'' '",
    "sql_window_nth": "SELECT user_id, event_id, nth_value(event_id, 2) OVER w AS second_id, last_value(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_window_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS near FROM part",
    "sql_window_groups": ("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM part) x", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part"),
    "sql_json_each": ("SELECT event_id, t.name AS key, t.v AS v FROM events LATERAL VIEW explode(from_json(props, 'map<string,string>')) t AS name, v", "SELECT event_id, j.key AS key, json_extract_string(props, '$.' || j.key) AS v FROM events, json_each(props) j"),
    "sql_json_group": ("SELECT n_regionkey, to_json(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name)) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey"),
    "sql_asof": ("SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS click_id FROM events) x WHERE event_type = 'purchase'", "SELECT p.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"),
    "sql_interval_join": "SELECT a.event_id, count(b.event_id) AS later FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '6' HOUR GROUP BY a.event_id",
    "sql_array": ("SELECT p_partkey, array_join(array_sort(split(p_name, ' ')), ',') AS words, size(split(p_name, ' ')) AS n, array_contains(split(p_name, ' '), 'red') AS red FROM part", "SELECT p_partkey, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS words, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, list_contains(string_split(p_name, ' '), 'red') AS red FROM part"),
    "sql_map": ("SELECT r_regionkey, element_at(map('k', r_regionkey, 'n', length(r_name)), 'n') AS n, try_element_at(map(r_name, 1), 'none') AS missing FROM region", "SELECT r_regionkey, MAP {'k': r_regionkey, 'n': CAST(length(r_name) AS INTEGER)}['n'] AS n, MAP {r_name: 1}['none'] AS missing FROM region"),
    "sql_udf": ("SELECT page_id, length(lenient_text(unhex(concat('FF', hex(url), 'C3')))) AS n FROM pages", "SELECT page_id, CAST(length(url) AS INTEGER) AS n FROM pages"),
    "sql_null": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS r, ifnull(nullif(n_name, ''), 'none') AS name FROM nation",
    "sql_cast": ("SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS bad, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS p FROM orders", "SELECT o_orderkey, try_cast(o_orderpriority AS INTEGER) AS bad, try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = tuple(t for t in DRIVER_TABLES if re.search(rf"\b{t}\b", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables)
        return query(spark, text)

    return run


QUERIES = {name: _query(t if isinstance(t, str) else t[0]) for name, t in TEXTS.items()}
ORACLE_SQL = {name: t if isinstance(t, str) else t[1] for name, t in TEXTS.items()}
