"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; vectors near a split spill into both halves. Trees
are fitted on a bounded sample, every vector is routed through all of them, vectors are compared within leaves in
double precision, and linked vectors are united. Equal vectors are one class from the start. A leaf is a block of
matrix products: it gives each vector's number of new links and a star forest, never its pairs; a pair that shares
several leaves counts in the first of them alone. Leaves of any size are compared in full, in pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, united_rows
from .scratch import stage
from .streams import binary_parts, bounds, groups, sorted_groups

TREES = 8
#: Share of a node's vectors on either side of its split that go to both halves.
SPILL = 0.10
#: Least half width of what spills, in distances at the wanted cosine; a node of which a larger share spills is a leaf.
MARGIN, MOST_SPILT = 0.5, 0.5
#: Trees are deep enough for leaves of about so many vectors of the most frequent label, as far as the sample goes.
LEAF = 400
#: Vectors of the sample; with their dimensions they bound the driver's memory.
SAMPLE = 20_000
LEAST_IN_SAMPLE = 16
#: Rows of a leaf that one task compares; more are dealt out in pairs of blocks.
BLOCK = 2_000
SEED = 20240


def _checked(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, d1, d2, vec): digest and bytes of usable vectors; dim 0 for those that link with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            label = batch.column("label")
            dim, d1, d2, out = [], [], [], []
            for i in range(batch.num_rows):
                value = column[i]
                ok = value.is_valid and label[i].is_valid and value.values.null_count == 0 and len(value.values) > 0
                if ok:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 equals 0.0
                    ok = bool(np.isfinite(x).all() and x.any())
                if ok:
                    raw = x.astype("<f8").tobytes()
                    digest = np.frombuffer(hashlib.blake2b(raw, digest_size=16).digest(), np.int64)
                    dim.append(len(x))
                    d1.append(int(digest[0]))
                    d2.append(int(digest[1]))
                    out.append(raw)
                else:
                    dim.append(0)
                    d1.append(0)
                    d2.append(0)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), label, pa.array(dim, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "d1", "d2", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(run, "vec_id long, label long, dim int, d1 long, d2 long, vec binary")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_forest(sample: np.ndarray, depth: int, least: float, trees: int = TREES) -> list[dict]:
    """Per tree: node number -> (direction, lower, upper) of inner nodes; children of node n are 2 n + 1 and 2 n + 2.

    What spills is at least as wide as MARGIN times the distance of unit vectors of cosine least; a node of which more
    than MOST_SPILT would spill is as narrow as that distance, and stays whole.
    """
    reach = MARGIN * math.sqrt(max(0.0, 2 - 2 * least))
    rng = np.random.default_rng(SEED)
    forest = []
    for _ in range(trees):
        nodes: dict[int, tuple] = {}
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level >= depth or len(rows) < LEAST_IN_SAMPLE:
                continue
            direction = rng.standard_normal(sample.shape[1])
            place = sample[rows] @ direction
            lower, middle, upper = np.quantile(place, [0.5 - SPILL, 0.5, 0.5 + SPILL])
            lower, upper = min(lower, middle - reach), max(upper, middle + reach)
            if ((place >= lower) & (place <= upper)).mean() > MOST_SPILT:
                continue
            nodes[node] = (direction, float(lower), float(upper))
            todo += [(2 * node + 1, rows[place <= upper], level + 1), (2 * node + 2, rows[place >= lower], level + 1)]
        forest.append(nodes)
    return forest


def route(forest: list[dict], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each leaf that a row of x reaches; a code names tree and leaf."""
    rows, codes = [], []
    for t, nodes in enumerate(forest):
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, here = todo.pop()
            if not len(here):
                continue
            if node not in nodes:
                rows.append(here)
                codes.append(np.full(len(here), (t << 40) + node))
                continue
            direction, lower, upper = nodes[node]
            place = x[here] @ direction
            todo += [(2 * node + 1, here[place <= upper]), (2 * node + 2, here[place >= lower])]
    return np.concatenate(rows), np.concatenate(codes).astype(np.int64)


def _leaves(reps: DataFrame, forests: dict[int, list[dict]]) -> DataFrame:
    """A row for each leaf of each vector: (label, dim, code, rid, n, vec, codes)."""
    shared = reps.sparkSession.sparkContext.broadcast(forests)  # bounded by the sample's size
    schema = "label long, dim int, code long, rid long, n long, vec binary, codes array<long>"

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for s in range(0, len(at), 2000):
                    part = batch.take(pa.array(at[s : s + 2000]))
                    raw, off = binary_parts(part.column("vec"))
                    x = unit_rows(raw[off[0] : off[-1]].view(np.float64).reshape(part.num_rows, dim))
                    row, code = route(shared.value.get(int(dim), [{}]), x)
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                    own = [code[cut[i] : cut[i + 1]] for i in range(part.num_rows)]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("label").take(take), part.column("dim").take(take), pa.array(code), part.column("rid").take(take), part.column("n").take(take), part.column("vec").take(take), pa.array([own[i] for i in row], pa.list_(pa.int64()))], names=["label", "dim", "code", "rid", "n", "vec", "codes"])

    return reps.select("label", "dim", "rid", "n", "vec").mapInArrow(run, schema)


def _compared(members: DataFrame, least: float) -> DataFrame:
    """(a, b, w): w new links of class a where b is null; else an edge of a leaf's star forest."""
    keys = ["label", "dim", "code", "x", "y"]

    def run(batches):
        for table in groups(batches, keys):
            cut = bounds(table, keys)
            rid, n, block, code, xs, ys, dims = (table.column(c).to_numpy() for c in ("rid", "n", "block", "code", "x", "y", "dim"))
            raw, off = binary_parts(table.column("vec"))
            codes = table.column("codes").combine_chunks()
            codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
            flat, edge = codes.values.to_numpy(), codes.offsets.to_numpy()
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                m = e - s
                if m < 2:
                    continue
                x = unit_rows(raw[off[s] : off[e]].view(np.float64).reshape(m, dims[s]))
                wide = int((edge[s + 1 : e + 1] - edge[s:e]).max())
                held = np.full((m, wide), -1, np.int64)
                for i in range(m):
                    own = flat[edge[s + i] : edge[s + i + 1]]
                    held[i, : len(own)] = own
                own = block[s:e]
                links, root = np.zeros(m, np.int64), np.arange(m)
                for at in range(0, m, 512):
                    i, j = np.nonzero(x[at : at + 512] @ x[at:].T >= least)
                    i, j = i + at, j + at
                    ok = i < j
                    if xs[s] != ys[s]:
                        ok &= own[i] != own[j]
                    i, j = i[ok], j[ok]
                    for c in range(0, len(i), 100_000):
                        a, b = i[c : c + 100_000], j[c : c + 100_000]
                        first = np.ones(len(a), bool)  # no smaller code in common
                        for k in range(wide):
                            here = held[a, k]
                            earlier = (here >= 0) & (here < code[s])
                            if not earlier.any():
                                break
                            first &= ~(earlier & (held[b] == here[:, None]).any(axis=1))
                        np.add.at(links, a[first], n[s + b[first]])
                        np.add.at(links, b[first], n[s + a[first]])
                    root = united_rows(root, i, j)
                some = np.flatnonzero(links)
                star = np.flatnonzero(root != np.arange(m))
                a = np.concatenate([rid[s + some], rid[s + star]])
                b = pa.array(np.concatenate([np.zeros(len(some), np.int64), rid[s + root[star]]]), mask=np.arange(len(a)) < len(some))
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[some], np.zeros(len(star), np.int64)]))], names=["a", "b", "w"])

    return sorted_groups(members, keys).mapInArrow(run, "a long, b long, w long")


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors (vec_id, embedding, label; more columns are ignored).

    Rows of equal, non-null label and equal length link when their cosine is at least least. A null, empty or zero
    vector, one with null or non-finite components and one without a label link with nothing. n_links counts other
    rows, equal ones and rows of equal vec_id too; component_id is the smallest vec_id reachable (null ids are never
    the smallest while there are others); kept: vec_id = component_id. No rows give no rows.
    """
    checked = stage(_checked(vectors).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    keys = ["label", "dim", "d1", "d2"]
    usable = checked.where("dim > 0")
    classes = stage(usable.groupBy(*keys).agg(F.min("rid").alias("rep"), F.min("vec_id").alias("least_id"), F.count("*").alias("n")), "vector-classes")
    reps = usable.select("rid", "vec").join(classes.select("label", "dim", F.col("rep").alias("rid"), "n"), "rid")
    reps = stage(reps, "representatives")

    most = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    total = reps.count()
    depth = max(0, math.ceil(math.log2(max(1, most / LEAF))))
    some = reps.select("dim", "vec").where(F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(max(1, -(-total // SAMPLE)))) == 0).orderBy(F.xxhash64("rid")).limit(SAMPLE).toPandas()
    forests = {int(dim): fit_forest(unit_rows(np.stack([np.frombuffer(v, np.float64) for v in part["vec"]])), depth, least) for dim, part in some.groupby("dim")}

    leaves = stage(_leaves(reps, forests), "leaves")
    group = ["label", "dim", "code"]
    sizes = leaves.groupBy(*group).agg(F.count("*").alias("c")).where("c > 1").select(*group, F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    dealt = leaves.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "j")).withColumn("y", F.greatest("block", "j")).drop("j", "blocks")
    found = stage(_compared(dealt, least), "links")

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("links"))
    comps = stage(components(found.where("b is not null").select("a", "b")), "vector-components").withColumnRenamed("node", "rep")
    merged = stage(classes.join(links, "rep", "left").join(comps, "rep", "left").select(*keys, "least_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("comp")), "classes-linked")
    ids = merged.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    merged = merged.join(ids, "comp").select(*keys, "n_links", "component_id")
    out = checked.select("vec_id", *keys).join(merged, keys, "left")
    component = F.when(F.col("dim") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
