"""The eight tables of the decision-support schema, made by integer arithmetic: the same rows on any cluster and in any dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows at scale factor 1; nation and region don't grow.
ROWS = {"region": 5, "nation": 25, "supplier": 10_000, "customer": 150_000, "part": 200_000, "partsupp": 800_000, "orders": 1_500_000, "lineitem": 6_000_000}
_SEGMENTS = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
_PRIORITIES = "'1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'"


def _mixed(i: str, salt: int, most: str) -> str:
    """A number from 0 to most - 1 that looks random, of a row's number below 2 to the 40."""
    return f"((({i} + {salt}) % 1000003) * 7919 + ({i} % 10007) * {104729 + salt}) % {most}"


def _pick(values: str, n: str) -> str:
    items = [v.strip() for v in values.split(",")]
    return "CASE " + n + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items)) + " END"


#: Columns of each table from the row number i, from 0 on; {table} is that table's number of rows. For Spark and DuckDB alike.
COLUMNS = {
    "region": "i AS r_regionkey, concat('REGION_', CAST(i AS VARCHAR(20))) AS r_name",
    "nation": "i AS n_nationkey, concat('NATION_', CAST(i AS VARCHAR(20))) AS n_name, i % 5 AS n_regionkey",
    "supplier": f"i + 1 AS s_suppkey, concat('Supplier#', CAST(i + 1 AS VARCHAR(20))) AS s_name, {_mixed('i', 1, '25')} AS s_nationkey, ({_mixed('i', 2, '1100000')} - 100000) / 100.0e0 AS s_acctbal",
    "customer": f"i + 1 AS c_custkey, concat('Customer#', CAST(i + 1 AS VARCHAR(20))) AS c_name, {_mixed('i', 3, '25')} AS c_nationkey, ({_mixed('i', 4, '1100000')} - 100000) / 100.0e0 AS c_acctbal, {_pick(_SEGMENTS, '(' + _mixed('i', 5, '5') + ')')} AS c_mktsegment",
    "part": f"i + 1 AS p_partkey, concat('part ', CAST({_mixed('i', 6, '1000')} AS VARCHAR(20))) AS p_name, concat('Brand#', CAST(11 + {_mixed('i', 7, '5')} * 10 + {_mixed('i', 8, '5')} AS VARCHAR(20))) AS p_brand, 1 + {_mixed('i', 9, '50')} AS p_size, (90000 + (i % 20001) * 10 + i % 1000) / 100.0e0 AS p_retailprice",
    "partsupp": f"1 + CAST(floor(i / 4.0e0) AS BIGINT) AS ps_partkey, 1 + (CAST(floor(i / 4.0e0) AS BIGINT) + (i % 4) * 2503) % {{supplier}} AS ps_suppkey, 1 + {_mixed('i', 10, '9999')} AS ps_availqty, (100 + {_mixed('i', 11, '99901')}) / 100.0e0 AS ps_supplycost",
    "orders": f"i + 1 AS o_orderkey, 1 + {_mixed('i', 12, '{customer}')} AS o_custkey, {_pick(chr(39) + 'F' + chr(39) + ', ' + chr(39) + 'O' + chr(39) + ', ' + chr(39) + 'P' + chr(39), '(' + _mixed('i', 13, '3') + ')')} AS o_orderstatus, (100000 + {_mixed('i', 14, '50000000')}) / 100.0e0 AS o_totalprice, {_mixed('i', 15, '2406')} AS o_orderday, {_pick(_PRIORITIES, '(' + _mixed('i', 16, '5') + ')')} AS o_orderpriority",
    "lineitem": f"1 + CAST(floor(i / 4.0e0) AS BIGINT) AS l_orderkey, 1 + i % 4 AS l_linenumber, 1 + {_mixed('i', 17, '{part}')} AS l_partkey, 1 + {_mixed('i', 18, '{supplier}')} AS l_suppkey, 1 + {_mixed('i', 19, '50')} AS l_quantity, (90000 + {_mixed('i', 20, '9910000')}) / 100.0e0 AS l_extendedprice, {_mixed('i', 21, '11')} / 100.0e0 AS l_discount, {_mixed('i', 22, '9')} / 100.0e0 AS l_tax, {_mixed('i', 23, '2526')} AS l_shipday",
}


def rows_of(table: str, scale: float) -> int:
    return ROWS[table] if table in ("region", "nation") else max(4, round(ROWS[table] * scale))


def columns_of(table: str, scale: float) -> str:
    return COLUMNS[table].format(**{t: rows_of(t, scale) for t in ROWS})


def generated(spark: SparkSession, table: str, scale: float) -> DataFrame:
    """One table; each task makes its own rows."""
    spark.range(rows_of(table, scale)).withColumnRenamed("id", "i").createOrReplaceTempView("generator_rows")
    return spark.sql(f"SELECT {columns_of(table, scale)} FROM generator_rows")
