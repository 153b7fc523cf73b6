"""The 22 decision-support queries on the tables at hand, with parameters that suit them."""

from __future__ import annotations

from .relational import count, mean, total

_REVENUE = "l_extendedprice * (1 - l_discount)"
_L, _O, _PS, _C, _S, _P = (f"{{{t}_x}}" for t in ("lineitem", "orders", "partsupp", "customer", "supplier", "part"))
_YEAR = "CAST(extract(YEAR FROM {}) AS BIGINT)"

QUERIES: dict[str, str] = {
    "tpch_q01": f"""SELECT l_returnflag, l_linestatus, {total('l_quantity')} AS sum_qty, {total('l_extendedprice')} AS sum_base_price, {total(_REVENUE)} AS sum_disc_price,
        {total(_REVENUE + ' * (1 + l_tax)', 6)} AS sum_charge, {mean('l_quantity')} AS avg_qty, {mean('l_extendedprice')} AS avg_price, {mean('l_discount')} AS avg_disc, {count()} AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": f"""SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_comment FROM {_P} p, {_S} s, {_PS} ps, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%PROMO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
        AND ps_supplycost = (SELECT min(ps2.ps_supplycost) FROM {_PS} ps2, supplier s2, nation n2, region r2 WHERE p.p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""SELECT l_orderkey, {total(_REVENUE)} AS revenue, o_orderdate, o_shippriority FROM customer, {_O} o, {_L} l
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate, o_shippriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": f"""SELECT o_orderpriority, {count()} AS order_count FROM {_O} o WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
        AND EXISTS (SELECT 1 FROM {_L} l WHERE l.l_orderkey = o.o_orderkey AND l.l_commitdate < l.l_receiptdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""SELECT n_name, {total(_REVENUE)} AS revenue FROM customer, {_O} o, {_L} l, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q06": f"""SELECT {total('l_extendedprice * l_discount')} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": f"""SELECT supp_nation, cust_nation, l_year, {total('volume')} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {_YEAR.format('l_shipdate')} AS l_year, {_REVENUE} AS volume
        FROM supplier, {_L} l, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN DATE '1998-01-01' AND DATE '1999-12-31') shipping
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""SELECT o_year, {total("CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0 END")} / {total('volume')} AS mkt_share FROM (SELECT {_YEAR.format('o_orderdate')} AS o_year, {_REVENUE} AS volume, n2.n_name AS nation_name
        FROM part, supplier, {_L} l, {_O} o, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND p_type = 'ECONOMY') all_nations GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""SELECT nation_name, o_year, {total('amount')} AS sum_profit FROM (SELECT n_name AS nation_name, {_YEAR.format('o_orderdate')} AS o_year, {_REVENUE} - ps_supplycost * l_quantity AS amount
        FROM part, supplier, {_L} l, {_PS} ps, {_O} o, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%') profit
        GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
    "tpch_q10": f"""SELECT c_custkey, c_name, {total(_REVENUE)} AS revenue, c_acctbal, n_name, c_phone FROM {_C} c, {_O} o, {_L} l, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, c_phone, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""SELECT ps_partkey, {total('ps_supplycost * ps_availqty')} AS part_value FROM {_PS} ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey
        HAVING {total('ps_supplycost * ps_availqty')} > (SELECT {total('ps_supplycost * ps_availqty')} * 0.001 FROM {_PS} ps2, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7') ORDER BY part_value DESC""",
    "tpch_q12": f"""SELECT l_shipmode, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders, {_L} l WHERE o_orderkey = l_orderkey AND l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND l_receiptdate >= DATE '1997-01-01' AND l_receiptdate < DATE '1998-01-01' GROUP BY l_shipmode ORDER BY l_shipmode""",
    "tpch_q13": f"""SELECT c_count, {count()} AS custdist FROM (SELECT c_custkey, {count('o_orderkey')} AS c_count FROM customer LEFT JOIN {_O} o ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""SELECT 100.00 * {total("CASE WHEN p_type LIKE 'PROMO%' THEN " + _REVENUE + " ELSE 0 END")} / {total(_REVENUE)} AS promo_revenue FROM {_L} l, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1998-09-01' AND l_shipdate < DATE '1998-10-01'""",
    "tpch_q15": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, {total(_REVENUE)} AS total_revenue FROM {_L} l WHERE l_shipdate >= DATE '1999-01-01' AND l_shipdate < DATE '1999-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""SELECT p_brand, p_type, p_size, {count('DISTINCT ps_suppkey')} AS supplier_cnt FROM {_PS} ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
        AND ps_suppkey NOT IN (SELECT s_suppkey FROM {_S} s WHERE s_comment LIKE '%Customer%Complaints%') GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": f"""SELECT {total('l_extendedprice')} / 7.0 AS avg_yearly FROM lineitem, {_P} p WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_container = 'MED BOX' AND l_quantity < (SELECT 0.2 * {mean('l2.l_quantity')} FROM lineitem l2 WHERE l2.l_partkey = p.p_partkey)""",
    "tpch_q18": f"""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, {total('l_quantity')} AS sum_qty FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""SELECT {total(_REVENUE)} AS revenue FROM {_L} l, {_P} p WHERE (p_partkey = l_partkey AND p_container IN ('SM BOX', 'SM CASE') AND l_quantity BETWEEN 1 AND 20 AND p_size BETWEEN 1 AND 25)
        OR (p_partkey = l_partkey AND p_container IN ('MED BOX', 'MED PKG') AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 35) OR (p_partkey = l_partkey AND p_container IN ('LG BOX', 'LG CASE') AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 50)""",
    "tpch_q20": f"""SELECT s_name FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM {_PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
        AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {_L} l WHERE l.l_partkey = ps.ps_partkey AND l.l_suppkey = ps.ps_suppkey AND l.l_shipdate >= DATE '1997-01-01' AND l.l_shipdate < DATE '1998-01-01')) AND s_nationkey = n_nationkey AND n_name = 'NATION_3' ORDER BY s_name""",
    "tpch_q21": f"""SELECT s_name, {count()} AS numwait FROM supplier, {_L} l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_receiptdate > l1.l_commitdate
        AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM {_L} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)
        AND s_nationkey = n_nationkey AND n_name = 'NATION_20' GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": f"""SELECT cntrycode, {count()} AS numcust, {total('c_acctbal')} AS totacctbal FROM (SELECT substring(c_phone, 1, 2) AS cntrycode, c_acctbal, c_custkey FROM {_C} c WHERE substring(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17')
        AND c_acctbal > (SELECT {mean('c_acctbal')} FROM {_C} c2 WHERE c_acctbal > 0.00 AND substring(c_phone, 1, 2) IN ('13', '31', '23', '29', '30', '18', '17'))
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND CAST(o_orderdate AS DATE) >= DATE '2000-06-01')) custsale GROUP BY cntrycode ORDER BY cntrycode""",
}
