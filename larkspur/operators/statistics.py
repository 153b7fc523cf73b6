"""Column statistics, join costs and orders, and layout advice."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the cost model.
DEFAULT_ROWS = 1_000_000
LEAST_SELECTIVITY = 1e-9
NO_EDGE_SELECTIVITY = 0.01
MERGE_JOIN_FROM = 500_000
CREATE_FROM = 0.30
STORAGE_COST_PER_GIB = 0.05


def column_statistics(df: DataFrame, exact: bool = True, sample_rows: int | None = None) -> DataFrame:
    """(column_name, row_count, ndv, null_count, min_value, max_value, null_fraction): one row for each column.

    Exact distinct counts take a scan of the one column each, since several in one aggregate would repeat every row for
    each column; approximate ones take one scan. sample_rows: of so many of the first rows alone.
    """
    df = df if sample_rows is None else df.limit(sample_rows)

    def of(columns: list[str], distinct) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in columns:
            aggs += [distinct(F.col(c)).alias(f"d_{c}"), F.count(c).alias(f"c_{c}"), F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}")]
        nulls = {c: F.col("n") - F.col(f"c_{c}") for c in columns}
        rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"d_{c}").alias("ndv"), nulls[c].alias("null_count"), F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value"), F.when(F.col("n") > 0, nulls[c] / F.col("n")).alias("null_fraction")) for c in columns]
        return df.select(*columns).agg(*aggs).select(F.inline(F.array(*rows)))

    if not exact:
        return of(df.columns, F.approx_count_distinct)
    parts = [of([c], F.count_distinct) for c in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of parts of a table as one: rows add up, distinct counts are the largest, null fractions the mean, bounds the widest."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("column_name").agg(F.sum("row_count").alias("row_count"), F.max("ndv").alias("ndv"), F.avg("null_fraction").alias("null_fraction"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"))


@dataclass
class JoinGraph:
    """Tables with row counts, and equality edges (table, column, table, column) with distinct values by column."""

    rows: dict[str, int]
    edges: list[tuple[str, str, str, str]]
    ndv: dict[tuple[str, str], int] = field(default_factory=dict)

    def selectivity(self, edge: tuple[str, str, str, str]) -> float:
        a, ca, b, cb = edge
        left = self.ndv.get((a, ca), self.rows.get(a, DEFAULT_ROWS))
        right = self.ndv.get((b, cb), self.rows.get(b, DEFAULT_ROWS))
        return 1 / max(left, right, 1)

    def between(self, done: set[str], table: str) -> list[tuple[str, str, str, str]]:
        return [e for e in self.edges if (e[0] in done and e[2] == table) or (e[2] in done and e[0] == table)]

    def cyclic(self) -> bool:
        """Whether some undirected cycle exists; several edges of one pair of tables count."""
        root = {t: t for t in self.rows}

        def find(t: str) -> str:
            while root[t] != t:
                t = root[t]
            return t

        for a, _, b, _ in self.edges:
            if find(a) == find(b):
                return True
            root[find(a)] = find(b)
        return False


def join_cost(left: float, right: float) -> float:
    """Hash join, or sort-merge join where both sides are large."""
    small, large = min(left, right), max(left, right)
    if small >= MERGE_JOIN_FROM:
        return 3 * (left * math.log2(max(left, 2)) + right * math.log2(max(right, 2)))
    return 2 * small + large


def plan_cost(graph: JoinGraph, order: list[str]) -> float:
    """Cost of a left-deep join in the given order."""
    rows, cost, done = float(graph.rows.get(order[0], DEFAULT_ROWS)), 0.0, {order[0]}
    for t in order[1:]:
        right = float(graph.rows.get(t, DEFAULT_ROWS))
        edges = graph.between(done, t)
        chosen = math.prod(graph.selectivity(e) for e in edges) if edges else NO_EDGE_SELECTIVITY
        cost += join_cost(rows, right)
        rows = max(1.0, rows * right * max(chosen, LEAST_SELECTIVITY))
        done.add(t)
    return cost


def best_order(graph: JoinGraph, most_exhaustive: int = 8) -> list[str]:
    """The cheapest left-deep order of up to most_exhaustive tables, greedy beyond; never dearer than the given one."""
    given = list(graph.rows)
    if len(given) <= most_exhaustive:
        return list(min(permutations(given), key=lambda o: (plan_cost(graph, list(o)), o)))
    order = [min(given, key=lambda t: (graph.rows[t], t))]
    while len(order) < len(given):
        rest = [t for t in given if t not in order]
        joined = [t for t in rest if graph.between(set(order), t)] or rest
        order.append(min(joined, key=lambda t: (plan_cost(graph, [*order, t]), t)))
    return min((order, given), key=lambda o: plan_cost(graph, o))


def layout_advice(accesses: DataFrame) -> DataFrame:
    """accesses (table_name, column_name, accesses, queries, table_rows, table_gib) with net_benefit and advised."""
    share = F.col("accesses") / F.col("queries")
    gain = F.least(F.col("table_rows") / F.log2(F.greatest(F.col("table_rows"), F.lit(2))) / 1e5, F.lit(0.9))
    net = share * gain - STORAGE_COST_PER_GIB * F.col("table_gib")
    return accesses.withColumn("net_benefit", net).withColumn("advised", net >= CREATE_FROM)
