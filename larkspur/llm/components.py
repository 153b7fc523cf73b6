"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node reachable.

    Each round shuffles the edges alone; no node's neighbours are gathered: the minimum is a partially
    aggregated group and goes back by a join whose large partitions Spark can split. Rounds grow with the
    logarithm of the longest path. Self-loops and repeats are allowed; rows with a null end are ignored.
    Without edges the result is empty.
    """
    current = stage(_directed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    before = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        current = stage(_directed(small), "stars")
        after = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def united_rows(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root after uniting the trees of i and j; each row points to the smallest row of its tree."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        changed = low != high
        if not changed.any():
            break
        np.minimum.at(root, high[changed], low[changed])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        i, j = i[changed], j[changed]
    return root
