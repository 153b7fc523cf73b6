"""The tables as views of one Spark session, and the derived columns that the 22 benchmark queries need.

The tables at hand lack some columns of the benchmark; they are derived by integer arithmetic alone, written so that
Spark and DuckDB read the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

#: Fixed values of the derived columns.
SHIP_MODES = ("AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK")
SHIP_INSTRUCTIONS = ("COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN")
CONTAINERS = ("SM CASE", "SM BOX", "MED BOX", "MED PKG", "LG CASE", "LG BOX", "JUMBO PKG", "WRAP JAR")


def _pick(index: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} {cases} END"


#: Derived tables as subqueries; {day} adds whole days to a date in the dialect at hand.
DERIVED = {
    "lineitem_x": f"""(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
        CAST(l_shipdate AS DATE) AS l_shipdate,
        {{day:CAST(l_shipdate AS DATE)|CAST((l_orderkey + l_linenumber) % 61 - 30 AS INT)}} AS l_commitdate,
        {{day:CAST(l_shipdate AS DATE)|CAST(1 + (l_partkey + l_linenumber) % 30 AS INT)}} AS l_receiptdate,
        {_pick('(l_orderkey + l_linenumber) % 7', SHIP_MODES)} AS l_shipmode,
        {_pick('(l_orderkey + l_linenumber) % 4', SHIP_INSTRUCTIONS)} AS l_shipinstruct FROM lineitem)""",
    "orders_x": """(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority, 0 AS o_shippriority,
        CASE o_orderkey % 10 WHEN 3 THEN 'special packages requests' WHEN 7 THEN 'special deposits requests' ELSE 'regular accounts' END AS o_comment FROM orders)""",
    "partsupp_x": "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS INT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)",
    "customer_x": "(SELECT *, concat(CAST(10 + c_nationkey AS STRING), '-555-0100') AS c_phone FROM customer)",
    "supplier_x": "(SELECT *, CASE s_suppkey % 9 WHEN 4 THEN 'Customer slow Complaints' ELSE 'quiet' END AS s_comment FROM supplier)",
    "part_x": f"(SELECT *, concat('Manufacturer#', CAST(1 + p_partkey % 5 AS STRING)) AS p_mfgr, {_pick('p_partkey % 8', CONTAINERS)} AS p_container FROM part)",
}


def expand(sql: str, dialect: str) -> str:
    """sql with {name_x} replaced by the derived tables, {day:d|n}, {days:a|b} and {bool:x} written for a dialect."""
    for name, text in DERIVED.items():
        sql = sql.replace("{" + name + "}", text)
    while (at := sql.find("{day")) >= 0:
        end = sql.index("}", at)
        kind, _, rest = sql[at + 1 : end].partition(":")
        left, _, right = rest.partition("|")
        if kind == "day":
            new = f"date_add({left}, {right})" if dialect == "spark" else f"CAST({left} + {right} AS DATE)"
        else:
            new = f"datediff({left}, {right})" if dialect == "spark" else f"date_diff('day', {right}, {left})"
        sql = sql[:at] + new + sql[end + 1 :]
    return sql


def run_sql(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """A query over the named tables; views carry the path's hash, so that directories don't disturb each other."""
    import re

    tag = f"_{abs(hash(sf_dir)) % 10**12}"
    sql = expand(sql, "spark")
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name + tag)
        sql = re.sub(rf"(?<![\w.'])({name})(?![\w.'(])", rf"{name}{tag}", sql)
    return spark.sql(sql)
