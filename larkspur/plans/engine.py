"""Queries that go through the engine's own tables, statements, text, statistics and generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import advice, statistics
from ..operators.database import Database
from ..operators.versioned import VersionedTable
from ..sources.generator import columns_of, generated, rows_of
from ..sources.tables import table
from ..sources.text import decoded, text_rows
from ..sources.workspace import workspace

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# versioned tables: all orders inserted at 1, every fifth dearer at 2, every seventh at 3, every eleventh deleted at 4

_PRICE = "o_totalprice {0} AS price"
_FIFTH, _SEVENTH = "+ CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END", "+ CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END"


def _history(spark: SparkSession, d: str, upto: int) -> VersionedTable:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    t = VersionedTable(spark, workspace(spark, "orders"), rows.schema)
    t.insert(rows)
    steps = [lambda: t.update({"price": F.col("price") + 1}, F.col("o_orderkey") % 5 == 0), lambda: t.update({"price": F.col("price") + 2}, F.col("o_orderkey") % 7 == 0), lambda: t.delete(F.col("o_orderkey") % 11 == 0)]
    for step in steps[: upto - 1]:
        step()
    return t


@_query(f"SELECT o_orderkey, {_PRICE.format(_FIFTH)} FROM orders")
def ver_update(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d, 2).snapshot()


@_query(f"SELECT o_orderkey, {_PRICE.format(_FIFTH + ' ' + _SEVENTH)} FROM orders WHERE o_orderkey % 11 <> 0")
def ver_delete(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d, 4).snapshot()


@_query(f"SELECT o_orderkey, {_PRICE.format(_FIFTH + ' ' + _SEVENTH)} FROM orders")
def ver_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d, 4).snapshot(3)


@_query(f"""SELECT 2 AS version, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE 'I' END AS op, o_orderkey, {_PRICE.format(_FIFTH)} FROM orders
  UNION ALL SELECT 3, 'U', o_orderkey, o_totalprice {_FIFTH} {_SEVENTH} FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 4, 'D', o_orderkey, o_totalprice {_FIFTH} {_SEVENTH} FROM orders WHERE o_orderkey % 11 = 0""")
def ver_gc(spark: SparkSession, d: str) -> DataFrame:
    kept = _history(spark, d, 4).collect_garbage(2, workspace(spark, "collected"))
    return kept.log().select(F.col("commit").cast("int").alias("version"), "op", "row.*")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 1 UNION ALL SELECT -1, 5e0")
def ver_transaction(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction sees of its own changes before it commits."""
    with _history(spark, d, 1).begin() as t:
        t.insert(spark.range(1).select(F.lit(-1).alias("o_orderkey"), F.lit(5.0).alias("price")))
        t.update({"price": F.lit(0.0)}, F.col("o_orderkey") % 3 == 0)
        t.delete(F.col("o_orderkey") % 4 == 1)
        t.snapshot().write.parquet(path := workspace(spark, "seen"))
        t.commit()
    return spark.read.parquet(path)


@_query("""SELECT * FROM (VALUES (1, 'a', CAST(2.5 AS DOUBLE), DATE '2024-02-29', true), (3, 'new', CAST(7 AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS BOOLEAN)), (-4, 'it''s', CAST(1 AS DOUBLE), DATE '1970-01-11', CAST(NULL AS BOOLEAN)))
  t(k, name, x, d, b)""")
def sql_statements(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE, INSERT with and without a column list, UPDATE, DELETE and bound parameters, as SQL text."""
    db = Database(spark, workspace(spark, "database"))
    db.execute("CREATE TABLE IF NOT EXISTS t (k INT, name TEXT, x DOUBLE, d DATE, b BOOLEAN)")
    db.execute("INSERT INTO t VALUES (1, 'a', 2.5, '2024-02-29', true), (2, 'b', -1, NULL, false), (3, NULL, NULL, NULL, NULL)")
    db.execute("INSERT INTO t (name, k, x, d) VALUES ($1, -4, true, 10)", ["it's"], ["text"])
    db.execute("UPDATE t SET name = 'new', x = 7 WHERE k >= 3")
    db.execute("DELETE FROM t WHERE x < 0")
    return db.execute("SELECT k, name, x, d, b FROM t")


# text

@_query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, printf('%.4f', c_acctbal) AS c_acctbal, CASE WHEN c_acctbal > 0 THEN 't' ELSE 'f' END AS owed FROM customer")
def text_result(spark: SparkSession, d: str) -> DataFrame:
    return text_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_acctbal") > 0).alias("owed")))


@_query("SELECT TRY_CAST(substring(c_name, 10) AS INTEGER) AS a, TRY_CAST(c_mktsegment AS DOUBLE) AS b, TRY_CAST(CAST(c_custkey AS VARCHAR) AS BIGINT) AS c FROM customer")
def decode_lenient(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.substring("c_name", 10, 100).alias("a"), F.col("c_mktsegment").alias("b"), F.col("c_custkey").cast("string").alias("c"))
    return decoded(rows, T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.LongType())]))


@_query("SELECT c_nationkey AS k, c_name AS name, CAST(NULL AS VARCHAR) AS other FROM customer UNION ALL BY NAME SELECT s_name AS other, s_nationkey AS k FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("other"))
    return left.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("other"), F.col("s_nationkey").alias("k")), allowMissingColumns=True)


# the generator

for _name, _scale in (("lineitem", 0.01), ("partsupp", 0.01), ("customer", 0.1), ("orders", 0.01)):
    QUERIES[f"generated_{_name}"] = lambda spark, d, name=_name, scale=_scale: generated(spark, name, scale)
    ORACLE_SQL[f"generated_{_name}"] = f"SELECT {columns_of(_name, _scale)} FROM (SELECT range AS i FROM range({rows_of(_name, _scale)})) r"


# statistics and advice

_STATISTICS = "SELECT '{0}' AS column_name, count(*) AS row_count, count(DISTINCT {0}) AS ndv, count(*) - count({0}) AS null_count, CAST(min({0}) AS VARCHAR) AS min_value, CAST(max({0}) AS VARCHAR) AS max_value, (count(*) - count({0})) / CAST(count(*) AS DOUBLE) AS null_fraction FROM {1}"


@_query(_STATISTICS.format("c_custkey", "customer") + " UNION ALL " + _STATISTICS.format("c_mktsegment", "customer"))
def stats_columns(spark: SparkSession, d: str) -> DataFrame:
    return statistics.column_statistics(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@_query("""WITH a AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS d, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders WHERE o_orderkey % 2 = 0),
  b AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS d, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders WHERE o_orderkey % 2 <> 0)
  SELECT 'o_custkey' AS column_name, a.n + b.n AS row_count, greatest(a.d, b.d) AS ndv, CAST(0 AS DOUBLE) AS null_fraction, least(a.lo, b.lo) AS min_value, greatest(a.hi, b.hi) AS max_value FROM a, b""")
def stats_merge(spark: SparkSession, d: str) -> DataFrame:
    key = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    parts = [statistics.column_statistics(key.where(c).select("o_custkey")) for c in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 != 0)]
    merged = statistics.merged_statistics(*[p.withColumns({c: F.col(c).cast("long") for c in ("min_value", "max_value")}) for p in parts])
    return merged.select("column_name", "row_count", "ndv", "null_fraction", "min_value", "max_value")


@_query("SELECT 1.0::DOUBLE / greatest((SELECT count(DISTINCT o_custkey) FROM orders), (SELECT count(DISTINCT c_custkey) FROM customer)) AS selectivity")
def join_selectivity(spark: SparkSession, d: str) -> DataFrame:
    ndv, rows = {}, {}
    for t, c in (("orders", "o_custkey"), ("customer", "c_custkey")):
        r = statistics.column_statistics(table(spark, d, t).select(c)).first()
        ndv[t, c], rows[t] = r.ndv, r.row_count
    edge = ("orders", "o_custkey", "customer", "c_custkey")
    return spark.createDataFrame([(statistics.JoinGraph(rows, [edge], ndv).selectivity(edge),)], "selectivity double")


#: table, column, accesses, queries, rows and GiB of the table: some at either side of the cut.
_WORKLOAD = [("lineitem", "l_shipdate", 70, 100, 1_000_000, 0.06), ("lineitem", "l_tax", 5, 100, 1_000_000, 0.06), ("orders", "o_custkey", 604, 1000, 1_000_000, 0.06), ("orders", "o_orderdate", 603, 1000, 1_000_000, 0.06), ("part", "p_size", 99, 100, 1_000, 0.01), ("orders", "o_clerk", 60, 100, 10_000_000, 0.9)]
_VALUES = ", ".join(f"('{t}', '{c}', {a}, {q}, {r}, CAST({g} AS DOUBLE))" for t, c, a, q, r, g in _WORKLOAD)


@_query(f"""SELECT table_name, column_name, round(net, 9) AS net_benefit, net >= 0.30 AS advised FROM (SELECT *, accesses / CAST(queries AS DOUBLE) * least(table_rows / log2(greatest(table_rows, 2)) / 1e5, 0.9) - 0.05 * table_gib AS net
  FROM (VALUES {_VALUES}) w(table_name, column_name, accesses, queries, table_rows, table_gib)) x""")
def index_advice(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_WORKLOAD, "table_name string, column_name string, accesses int, queries int, table_rows long, table_gib double")
    return statistics.layout_advice(rows).select("table_name", "column_name", F.round("net_benefit", 9).alias("net_benefit"), "advised")


@_query("""SELECT 'events' AS table_name, event_type AS column_name, count(*) AS predicates, 0 AS joins, count(DISTINCT event_id) AS accesses FROM
  (SELECT * FROM events ORDER BY event_id DESC, event_type LIMIT 10000) e GROUP BY event_type""")
def workload_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events as the log of a workload: each one query with a predicate on the column named by its type."""
    log = table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.lit("events").alias("table_name"), F.col("event_type").alias("column_name"), F.lit("predicate").alias("kind"), F.to_date("ts").alias("day"))
    return advice.workload_counts(log).select("table_name", "column_name", "predicates", F.col("joins").cast("int").alias("joins"), "accesses")
