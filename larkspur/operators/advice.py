"""Join graphs of the 22 decision-support queries, the log of a workload, and layout advice from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import CREATE_FROM, JoinGraph, layout_advice

#: Rows at scale factor 1.
ROWS = {"lineitem": 6_000_000, "orders": 1_500_000, "partsupp": 800_000, "part": 200_000, "customer": 150_000, "supplier": 10_000, "nation": 25, "region": 5}
#: The equality edges that the queries use, by a short name.
EDGES = {
    "lo": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "lp": ("lineitem", "l_partkey", "part", "p_partkey"),
    "ls": ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    "lps": ("lineitem", "l_partkey", "partsupp", "ps_partkey"),
    "oc": ("orders", "o_custkey", "customer", "c_custkey"),
    "cn": ("customer", "c_nationkey", "nation", "n_nationkey"),
    "sn": ("supplier", "s_nationkey", "nation", "n_nationkey"),
    "nr": ("nation", "n_regionkey", "region", "r_regionkey"),
    "psp": ("partsupp", "ps_partkey", "part", "p_partkey"),
    "pss": ("partsupp", "ps_suppkey", "supplier", "s_suppkey"),
}
#: Tables in FROM order, and edges, of each query.
GRAPHS = {
    1: ("lineitem", ""),
    2: ("part supplier partsupp nation region", "psp pss sn nr"),
    3: ("customer orders lineitem", "oc lo"),
    4: ("orders lineitem", "lo"),
    5: ("customer orders lineitem supplier nation region", "oc lo ls sn nr"),
    6: ("lineitem", ""),
    7: ("supplier lineitem orders customer nation", "ls lo oc sn"),
    8: ("part supplier lineitem orders customer nation region", "lp ls lo oc cn nr"),
    9: ("part supplier lineitem partsupp orders nation", "ls lps lp lo sn"),
    10: ("customer orders lineitem nation", "oc lo cn"),
    11: ("partsupp supplier nation", "pss sn"),
    12: ("orders lineitem", "lo"),
    13: ("customer orders", "oc"),
    14: ("lineitem part", "lp"),
    15: ("supplier lineitem", "ls"),
    16: ("partsupp part", "psp"),
    17: ("lineitem part", "lp"),
    18: ("customer orders lineitem", "oc lo"),
    19: ("lineitem part", "lp"),
    20: ("supplier nation partsupp part", "sn pss psp"),
    21: ("supplier lineitem orders nation", "ls lo sn"),
    22: ("customer orders", "oc"),
}
#: Days without an access after which a layout is dropped, and accesses kept of a workload.
IDLE_DAYS = 7
MOST_ACCESSES = 10_000


def query_graph(number: int, scale: float = 1.0) -> JoinGraph | None:
    """The join graph of one of the 22 queries; None for other numbers."""
    if number not in GRAPHS:
        return None
    tables, edges = GRAPHS[number]
    rows = {t: ROWS[t] if t in ("nation", "region") else max(1, round(ROWS[t] * scale)) for t in tables.split()}
    return JoinGraph(rows, [EDGES[e] for e in edges.split()])


def workload_counts(log: DataFrame) -> DataFrame:
    """(table_name, column_name, predicates, joins, accesses, queries, last_day) of a log (query_id, table_name, column_name, kind, day).

    kind is predicate or join; the last MOST_ACCESSES rows by query count. queries: all queries of the log.
    """
    recent = log.orderBy(F.desc("query_id"), "table_name", "column_name", "kind").limit(MOST_ACCESSES)
    total = recent.agg(F.count_distinct("query_id").alias("queries"))
    by = recent.groupBy("table_name", "column_name").agg(F.count_if(F.col("kind") == "predicate").alias("predicates"), F.count_if(F.col("kind") == "join").alias("joins"), F.count_distinct("query_id").alias("accesses"), F.max("day").alias("last_day"))
    return by.join(F.broadcast(total))  # one row


def advised_layouts(counts: DataFrame, tables: DataFrame, today) -> DataFrame:
    """(action, table_name, columns, net_benefit) from counts of a workload and tables (table_name, table_rows, table_gib, laid_out).

    create: columns whose net benefit reaches CREATE_FROM, and of a table with two or more of them the best two
    together; drop: columns of laid_out (an array) without an access for IDLE_DAYS days before today.
    """
    rated = layout_advice(counts.join(tables.select("table_name", "table_rows", "table_gib"), "table_name")).where(F.col("net_benefit") >= CREATE_FROM)
    place = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("net_benefit"), "column_name"))
    rated = rated.withColumn("place", place)
    single = rated.select(F.lit("create").alias("action"), "table_name", F.array("column_name").alias("columns"), "net_benefit")
    best = rated.where("place <= 2").groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("place", "column_name"))).alias("two"), F.max("net_benefit").alias("net_benefit")).where("size(two) = 2")
    pair = best.select(F.lit("create").alias("action"), "table_name", F.col("two.column_name").alias("columns"), "net_benefit")
    used = counts.select("table_name", "column_name", "last_day")
    laid = tables.select("table_name", F.explode("laid_out").alias("column_name")).join(used, ["table_name", "column_name"], "left")
    idle = laid.where(F.col("last_day").isNull() | (F.datediff(F.lit(today), "last_day") >= IDLE_DAYS))
    drop = idle.select(F.lit("drop").alias("action"), "table_name", F.array("column_name").alias("columns"), F.lit(0.0).alias("net_benefit"))
    return single.unionByName(pair).unionByName(drop)
