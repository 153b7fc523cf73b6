"""Queries for scans, scalars, aggregates, sorts, joins, subqueries, set operations and windows.

Each is one text for Spark and DuckDB. Sums of money are exact decimals, so that the order of addition doesn't show.
"""

from __future__ import annotations

QUERIES: dict[str, str] = {}


def total(x: str, scale: int = 4) -> str:
    """An exact sum of x, as a double."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE)"


def mean(x: str) -> str:
    return f"({total(x)} / count({x}))"


def count(x: str = "*") -> str:
    return f"CAST(count({x}) AS BIGINT)"


QUERIES |= {
    # scans, filters, predicates
    "scan_projection": "SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice FROM lineitem",
    "filter_compare": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_partkey <> 7 AND l_suppkey < 50",
    "filter_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderkey NOT BETWEEN 100 AND 200",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR p_brand LIKE 'Brand#1_'",
    "filter_not_like": "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE 'PROMO%'",
    "filter_ilike": "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'economy%' OR p_name ILIKE '%RED%'",
    "filter_not_ilike": "SELECT p_partkey, p_type FROM part WHERE p_type NOT ILIKE 'econ%'",
    "filter_and_or_not": "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND NOT (o_totalprice < 1000)",
    "filter_null_logic": "SELECT n_nationkey, nullif(n_regionkey, 2) = nullif(n_regionkey, 2) AS eq_self, (nullif(n_regionkey, 2) = 1 OR n_nationkey > 10) AS either, nullif(n_regionkey, 2) IN (1, NULL) AS in_null FROM nation WHERE nullif(n_regionkey, 2) IS NULL OR nullif(n_regionkey, 3) IS NOT NULL",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS bucket FROM orders",
    "case_simple": "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS seg FROM customer",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "const_select": "SELECT 42 AS answer, 'text' AS word, DATE '2024-01-02' AS d, CAST(NULL AS INT) AS nothing",
    # scalars
    "arith_ops": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - 1 AS b, l_quantity * 2 AS c, -l_linenumber AS d, l_orderkey + l_partkey * 3 AS e FROM lineitem",
    "int_div_mod": "SELECT o_orderkey, o_orderkey / 4 AS quotient, CAST(floor(o_orderkey / 4) AS BIGINT) AS whole, o_orderkey % 7 AS rest FROM orders",
    "string_funcs": "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substring(p_name, 2, 4) AS part_name, trim(concat('  ', p_type, ' ')) AS trimmed FROM part",
    "concat_op": "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS STRING) AS joined, nullif(n_name, 'NATION_3') || 'x' AS maybe FROM nation",
    "coalesce_nullif": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS region_key, nullif(n_name, 'NATION_2') AS name FROM nation",
    "extract_parts": "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "date_literal_filter": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) < DATE '1996-07-01'",
    "date_diff_days": "SELECT o_orderkey, CAST({days:CAST(o_orderdate AS DATE)|DATE '1995-01-01'} AS BIGINT) AS days FROM orders",
    "cast_matrix": "SELECT CAST('42' AS INT) AS i, CAST('1.5' AS DOUBLE) AS x, CAST('true' AS BOOLEAN) AS b, CAST('2024-02-29' AS DATE) AS d, CAST(7 AS STRING) AS s, CAST(2147483648 AS BIGINT) AS l",
    # aggregates
    "agg_global": f"SELECT {count()} AS n, {total('l_extendedprice')} AS price, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem",
    "agg_empty": f"SELECT {count()} AS n, {total('l_extendedprice')} AS price, max(l_orderkey) AS most FROM lineitem WHERE l_quantity < 0",
    "agg_count_variants": f"SELECT {count()} AS n, {count('nullif(n_regionkey, 2)')} AS some, {count('n_name')} AS names FROM nation",
    "agg_count_distinct": f"SELECT l_returnflag, {count('DISTINCT l_partkey')} AS parts, {count('DISTINCT l_suppkey')} AS suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_sum_avg": f"SELECT l_linestatus, {total('l_quantity')} AS qty, {mean('l_extendedprice')} AS price FROM lineitem GROUP BY l_linestatus",
    "agg_min_max_typed": "SELECT c_nationkey, min(c_name) AS first_name, max(c_mktsegment) AS last_segment, min(c_acctbal) AS least FROM customer GROUP BY c_nationkey",
    "agg_min_max_dates": "SELECT o_orderpriority, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY o_orderpriority",
    "agg_expr": f"SELECT l_returnflag, 100 * {total('l_discount')} / {total('l_quantity')} AS ratio, -{total('l_tax')} + 7 AS shifted FROM lineitem GROUP BY l_returnflag",
    "agg_conditional": f"SELECT l_linestatus, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large, {total('CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END')} AS cut FROM lineitem GROUP BY l_linestatus",
    "agg_having": f"SELECT l_suppkey, {count()} AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600",
    "having_no_group": f"SELECT {count()} AS n FROM orders HAVING count(*) > 1",
    "group_by_expr": f"SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderkey % 3 AS k, {count()} AS n FROM orders GROUP BY extract(YEAR FROM o_orderdate), o_orderkey % 3",
    "agg_bundle": f"SELECT l_returnflag, {total('l_extendedprice')} AS s, {count('l_extendedprice')} AS n, {mean('l_extendedprice')} AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag ORDER BY l_returnflag",
    # sort and limit
    "order_multi": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal ASC, c_custkey",
    "order_nulls": "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_nationkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_comma": "SELECT s_name, n_name, r_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join_multi_key": f"SELECT a.l_orderkey, {count()} AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey",
    "join_theta": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_left": "SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 49",
    "join_left_is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000 WHERE o_orderkey IS NULL",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey",
    "join_using": "SELECT k, x, y FROM (SELECT c_nationkey AS k, c_custkey AS x FROM customer) a JOIN (SELECT s_nationkey AS k, s_suppkey AS y FROM supplier) b USING (k)",
    "join_natural": "SELECT k, x, y FROM (SELECT c_nationkey AS k, c_custkey AS x FROM customer) a NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS y FROM nation) b",
    "join_self": "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_null_keys": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON nullif(a.n_regionkey, 2) = nullif(b.n_regionkey, 2)",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_or_common_key": f"SELECT {count()} AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_size < 10 AND l_quantity > 30) OR (p_partkey = l_partkey AND p_size > 40 AND l_quantity < 10)",
    # subqueries and CTEs
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
    "sub_scalar_correlated": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "sub_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sub_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "sub_not_in_null": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 3 OR n_nationkey = 3)",
    "sub_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)",
    "sub_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "sub_correlated_two_level": "SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000))",
    "derived_table": f"SELECT k, {count()} AS n FROM (SELECT o_custkey % 10 AS k FROM orders WHERE o_orderstatus = 'O') d GROUP BY k",
    "cte_single": "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey",
    "cte_chain": "WITH a(k, p) AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT k, max(p) AS m FROM a GROUP BY k), c AS (SELECT k FROM b WHERE m > 100000) SELECT c_custkey, c_name FROM customer JOIN c ON c.k = c_custkey",
    # set operations
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey > 40",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_nested_ordered": "SELECT k FROM ((SELECT n_nationkey AS k FROM nation UNION SELECT 100) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0) u ORDER BY k DESC",
    # windows
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank": "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS r FROM customer",
    "win_lag": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders",
    "win_lead": "SELECT o_orderkey, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders",
    "win_lag_offset": "SELECT o_orderkey, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ahead FROM orders",
    "win_after_group_by": "SELECT o_custkey, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) g",
    # extras
    "rollup": f"SELECT l_returnflag, l_linestatus, {count()} AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": f"SELECT l_returnflag, l_linestatus, {count()} AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "dense_rank": "SELECT c_custkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS r FROM customer",
    "win_frame_sum": "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders",
    "events_tumbling": f"SELECT event_type, date_trunc('day', ts) AS day, {count()} AS n FROM events GROUP BY event_type, date_trunc('day', ts)",
}
