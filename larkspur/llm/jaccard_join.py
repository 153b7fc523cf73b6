"""N-gram Jaccard join by signature trees.

Documents become sets of hashed word n-grams (64 bits, of which 48 are kept). Which documents are compared at all
is decided by a lossless prefix filter: sets with intersection / union >= t share one of the first
n - ceil(t n) + 1 elements in any common order. The order puts grams that are frequent in a sample last
(the sample steers only cost, never the result). The rows of one prefix gram come together with their bitmaps; there
a signature tree is traversed against itself: nodes hold OR-combined bitmaps and ranges of size, and a pair of nodes
is left out when its greatest possible overlap is below what the threshold asks for, or when all of its rows are united
already. What the tree lets through is a forest of rows that may link; each of its clusters comes together once with its
whole sets, and there the pairs of another tree are verified and united at once. So a task gives one row less than it has
members at most, and never the pairs of a group, and a document's set moves once however many grams it shares.

Equal sets are one class from the start, and groups of equal min-hashes are united first, by the same trees, so that most
prefix grams of near copies lie in one component and need no comparison. Grams and clusters with more rows than a task should
hold are split into blocks by size and component; which pairs of blocks are compared is a join of the blocks' own nodes
(ranges of size and component), and rows only move to the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, united_rows
from .hashing import NOT_SPACE, U, gram_hashes, mix, signed, text_chunks, word_hashes
from .scratch import small, stage
from .streams import binary_parts, bounds, groups, sorted_groups

#: Frequent grams come from one in SPARSE documents, or from more, so that the sample has SAMPLE_DOCS; so many at most.
SAMPLE_DOCS, SPARSE = 8_000, 64
FREQUENT_GRAMS = 400_000
#: Min-hashes whose groups are united first.
MIN_HASHES = 4
#: Rows, and grams in all, of one key that a block holds; a task compares two blocks.
BLOCK, BLOCK_GRAMS = 4_000, 2_000_000
LEAF = 32
#: Bits of a bitmap for each gram at least, in the pass that only prunes, and in the one that verifies.
BITS, MORE_BITS = 2, 16
#: Stored bytes of the list of rows and tasks that is sent to all executors at most.
MOST_SENT = 8 << 20

_SET_SCHEMA = "doc_id long, th long, n int, k1 long, k2 long, mins array<long>, prefix array<long>, bits binary, grams binary"


def document_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes (48 bits) of its word k-grams; fewer words make one gram, none make none."""
    all_grams = gram_hashes(words, k) >> U(16)
    for s, e in zip(firsts[:-1], firsts[1:], strict=True):
        if e - s >= k:
            yield np.unique(all_grams[s : e - k + 1])
        elif e > s:
            yield gram_hashes(words[s:e], int(e - s)) >> U(16)
        else:
            yield np.zeros(0, U)


def _pack48(grams: np.ndarray) -> bytes:
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def set_table(docs: DataFrame, k: int, percent: int, shared: Broadcast) -> DataFrame:
    """One row per document: its set, its size, the set's key, min-hashes and prefix. shared: the frequent grams, sorted."""

    def run(batches):
        common = shared.value
        odd = [U((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64) for i in range(MIN_HASHES)]
        for batch in batches:
            for at, data, off in text_chunks(batch.column("text")):
                words, firsts = word_hashes(data, off, NOT_SPACE)
                n, k1, k2, mins, prefix, bits, grams = [], [], [], [], [], [], []
                for s in document_sets(words, firsts, k):
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        k1.append(int(mix(s).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                        k2.append(int(mix(s ^ U(0x5DEECE66D)).sum(dtype=U).astype(np.int64)) if len(s) else 0)
                        mins.append(signed(np.array([(s * o).min() for o in odd], U)) if len(s) else [])
                    p = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    if p and len(common):
                        at_common = np.searchsorted(common, s)
                        known = common[np.minimum(at_common, len(common) - 1)] == s
                        rare = s[~known][:p]
                        prefix.append(signed(np.concatenate([rare, s[known][: p - len(rare)]])))
                    else:
                        prefix.append(signed(s[:p]))
                    bits.append(bitmap(s, BITS).tobytes())
                    grams.append(_pack48(s))
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, rows), batch.column("th").slice(at, rows), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(grams, pa.binary())],
                    names=["doc_id", "th", "n", "k1", "k2", "mins", "prefix", "bits", "grams"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, _SET_SCHEMA)


def frequent_grams(docs: DataFrame, k: int) -> np.ndarray:
    """Grams of at least four of the sample's distinct texts, the most frequent first kept; sorted by hash."""
    every = max(1, min(SPARSE, docs.count() // SAMPLE_DOCS))
    some = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(every)) == 0).where("text is not null")

    def run(batches):
        for batch in batches:
            for _, data, off in text_chunks(batch.column("text")):
                words, firsts = word_hashes(data, off, NOT_SPACE)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(list(document_sets(words, firsts, k)))))], names=["g"])

    counts = some.mapInArrow(run, "g long").groupBy("g").count().where("count >= 4")
    rows = counts.orderBy(F.desc("count"), "g").limit(FREQUENT_GRAMS).select("g").toPandas()
    return np.sort(rows["g"].to_numpy().astype(np.int64)).view(U)


def bitmap(grams: np.ndarray, times: int, size: int | None = None) -> np.ndarray:
    """A set's bitmap, of the power of two from times bits for each of size grams on, 256 at least."""
    width = max(256, 1 << math.ceil(math.log2(times * max(len(grams) if size is None else size, 1))))
    bits = np.zeros(width, bool)
    bits[(mix(grams) & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps brought to the narrowest one's width."""
    width = min(map(len, maps))
    return np.stack([m if len(m) == width else np.bitwise_or.reduce(m.reshape(-1, width), axis=0) for m in maps])


class _Tree:
    """Levels of nodes over rows sorted by size: OR of bitmaps, range of size, largest surplus of grams over set bits."""

    def __init__(self, size: np.ndarray, maps: np.ndarray):
        self.leaf = maps
        self.count = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = []
        n, m, lo, hi, surplus = len(maps), maps, size, size, size - self.count
        step = LEAF
        while True:
            cut = np.arange(0, n, step)
            m, lo, hi, surplus = np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(surplus, cut)
            self.levels.append((m, lo, hi, surplus))
            n, step = len(cut), 4
            if n == 1:
                break


def _fits(overlap, na, nb, percent):
    return overlap * (100 + percent) >= percent * (na + nb)


def tree_pairs(size: np.ndarray, maps: np.ndarray, percent: int, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows whose signatures allow the threshold, the likeliest of two leaves first; rows come sorted by size.

    labels: numbers for each row, which may change meanwhile; pairs of nodes whose rows all have the same are left out.
    """
    tree = _Tree(size, maps)
    top = len(tree.levels) - 1
    todo = [(top, 0, 0)]
    while todo:
        level, x, y = todo.pop()
        span = LEAF * 4**level
        if any(bool((v[span * x : span * (x + 1)] == v[span * x]).all() and (v[span * y : span * (y + 1)] == v[span * x]).all()) for v in labels):
            continue
        m, lo, hi, surplus = tree.levels[level]
        if x != y:
            if 100 * hi[x] < percent * lo[y] or 100 * hi[y] < percent * lo[x]:
                continue
            most = min(hi[x], hi[y], min(surplus[x], surplus[y]) + int(np.bitwise_count(m[x] & m[y]).sum()))
            if not _fits(most, lo[x], lo[y], percent):
                continue
        if level:
            below = len(tree.levels[level - 1][1])
            xs, ys = range(4 * x, min(4 * x + 4, below)), range(4 * y, min(4 * y + 4, below))
            todo += [(level - 1, i, j) for i in xs for j in ys if x != y or i <= j]
            continue
        xs, ys = slice(LEAF * x, min(LEAF * x + LEAF, len(size))), slice(LEAF * y, min(LEAF * y + LEAF, len(size)))
        both = np.bitwise_count(tree.leaf[xs, None, :] & tree.leaf[None, ys, :]).sum(axis=2, dtype=np.int64)
        sx, sy = size[xs, None], size[None, ys]
        most = np.minimum(both + np.minimum(sx - tree.count[xs, None], sy - tree.count[None, ys]), np.minimum(sx, sy))
        i, j = np.nonzero(_fits(most, sx, sy, percent))
        if x == y:
            i, j = i[i < j], j[i < j]
        if len(i):
            order = np.argsort(-(most[i, j] / (size[i + xs.start] + size[j + ys.start])), kind="stable")
            yield i[order] + xs.start, j[order] + ys.start


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return bool(_fits(both, len(x), len(y), percent))


def _bands(size: np.ndarray, percent: int) -> np.ndarray:
    """Bands of sizes, such that sets that link are of one band or of two that adjoin."""
    return np.floor(np.log(size) / math.log(100 / (percent - 1))).astype(np.int64)


def candidates(size: np.ndarray, maps: list[np.ndarray], percent: int, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """tree_pairs() of rows sorted by size, band by band, so that bitmaps of one tree have much the same width."""
    bands = _bands(size, percent)
    for band in np.unique(bands):
        s, m, e = np.searchsorted(bands, [band, band + 1, band + 2])
        if e - s < 2:
            continue
        for i, j in tree_pairs(size[s:e], folded(maps[s:e]), percent, *[v[s:e] for v in labels]):
            ok = (i < m - s) | (j < m - s)  # two of the upper band meet in its own tree
            yield i[ok] + s, j[ok] + s


def united(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Verified links, as index pairs, that unite the rows as far as they can be; none within one of comp.

    block: links within one block aren't looked for.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    root = np.unique(comp, return_inverse=True)[1].reshape(-1)[order]
    own = None if block is None else block[order]
    size = size[order]
    out = []
    if len(sets) == 2:
        found = iter([(np.array([0]), np.array([1]))])
    else:
        found = candidates(size, [bitmap(sets[i], MORE_BITS) for i in order], percent, root)
    for i, j in found:
        ok = root[i] != root[j]
        if own is not None:
            ok &= own[i] != own[j]
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if root[a] != root[b] and similar(sets[order[a]], sets[order[b]], percent):
                out.append((int(order[a]), int(order[b])))
                root[root == root[b]] = root[a]
    return out


_TASK = ["g", "x", "y"]


def _promising(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of a forest of the rows of each task (g, x, y, rid, comp, pos, block, n, bits) that may link.

    The task's tree pairs rows of different components whose first common key is g: none of the pos grams before
    it is in common. Rows of one tree of the forest are compared with each other later, the others aren't.
    """

    def run(batches):
        for table in groups(batches, _TASK):
            cut = bounds(table, _TASK)
            rid, comp, block, x, y, n, pos = (table.column(c).to_numpy() for c in ("rid", "comp", "block", "x", "y", "n", "pos"))
            raw, off = binary_parts(table.column("bits"))
            a, b = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2 or comp[s:e].min() == comp[s:e].max():
                    continue
                order = s + np.argsort(n[s:e], kind="stable")
                size, least = n[order].astype(np.int64), (n - pos)[order].astype(np.int64)
                part, own, root = comp[order], block[order], np.arange(e - s)
                for i, j in candidates(size, [raw[off[r] : off[r + 1]] for r in order], percent, part, root):
                    ok = (part[i] != part[j]) & (root[i] != root[j]) & _fits(np.minimum(least[i], least[j]), size[i], size[j], percent)
                    if x[s] != y[s]:
                        ok &= own[i] != own[j]
                    united_rows(root, i[ok], j[ok])
                some = np.flatnonzero(root != np.arange(e - s))
                a.append(rid[order[some]])
                b.append(rid[order[root[some]]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *v])) for v in (a, b)], names=["a", "b"])

    return sorted_groups(dealt.select(*_TASK, "rid", "comp", "block", "n", "pos", "bits"), _TASK).mapInArrow(run, "a long, b long")


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between the rows of each task (g, x, y) of dealt (g, x, y, rid, comp, block, grams)."""

    def run(batches):
        for table in groups(batches, _TASK):
            cut = bounds(table, _TASK)
            rid, comp, block, x, y = (table.column(c).to_numpy() for c in ("rid", "comp", "block", "x", "y"))
            raw, off = binary_parts(table.column("grams"))
            a, b = [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s < 2 or comp[s:e].min() == comp[s:e].max():
                    continue
                sets = [_unpack48(raw[off[r] : off[r + 1]]) for r in range(s, e)]
                for i, j in united(sets, comp[s:e], block[s:e] if x[s] != y[s] else None, percent):
                    a.append(rid[s + i])
                    b.append(rid[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return sorted_groups(dealt, _TASK).mapInArrow(run, "a long, b long")


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Those of rows (g, rid, n, pos, comp) whose key g has several components, with the number of blocks of the key.

    Keys with the same rows need one comparison: of those with equal digests of their rows the first in order stays.
    Rows next to which no other of their key has a size in reach are left out; so many grams as pos are not in common.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")  # one exchange for both uses
    digest = [F.count("*").alias("c"), F.sum("n").alias("total"), F.min("rid").alias("r0"), F.max("rid").alias("r1"), F.bit_xor(F.xxhash64("rid")).alias("x0"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("x1"), F.min_by("pos", "rid").alias("place")]
    keys = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *digest).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int")
    lone = keys.groupBy("c", "total", "r0", "r1", "x0", "x1").agg(F.min_by("g", "place").alias("g")).select("g", blocks.alias("blocks"))
    by_size = Window.partitionBy("g").orderBy("n", "rid")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = (100 * below >= percent * F.col("n")) | ((100 * F.col("n") >= percent * above) & ((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + above)))
    return rows.join(lone, "g").withColumn("near", near).where("near").drop("near")


def _dealt(rows: DataFrame, percent: int, across: bool) -> DataFrame:
    """Tasks (g, x, y) of the rows of _shared(): (g, x, y, rid, comp, pos, block); across: also the pairs of different blocks."""
    zero = F.lit(0).cast("long")
    out = rows.where("blocks = 1").select("g", zero.alias("x"), zero.alias("y"), "rid", "comp", "pos", zero.alias("block"))
    many = rows.where("blocks > 1")
    if not many.limit(1).count():
        return out
    if not across:
        block = F.pmod(F.xxhash64("g", "rid"), F.col("blocks")).cast("long")
        return out.unionByName(many.select("g", block.alias("x"), block.alias("y"), "rid", "comp", "pos", block.alias("block")))
    # blocks of neighbouring sizes; rows of one component side by side, a large component in blocks of its own
    band = F.floor(F.log("n") / F.lit(math.log(100 / (percent - 1)))).cast("long")
    many = many.withColumn("band", band).withColumn("bucket", F.pmod(F.xxhash64("comp"), F.col("blocks")).cast("long"))
    cells = many.groupBy("g", "band", "bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    placed = many.join(cells, ["g", "band", "bucket"]).withColumn("sub", F.pmod(F.xxhash64("rid"), F.col("parts")))
    placed = stage(placed.select("g", "rid", "n", "pos", "comp", "band", ((F.col("band") * 2**40) + (F.col("bucket") * 2**20) + F.col("sub")).cast("long").alias("block")), "blocks")
    nodes = placed.groupBy("g", "band", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    near = nodes.select("g", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("block").alias("x"), F.col("least").alias("x_least"), F.col("most").alias("x_most"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"))
    # a pair of one band meets there once in order, one of adjoining bands in the upper
    left = nodes.select("g", "band", F.col("block").alias("y"), F.col("least").alias("y_least"), F.col("most").alias("y_most"), F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"))
    alone = "x_lo = x_hi and y_lo = y_hi and x_lo = y_lo"
    pairs = near.join(left, ["g", "band"]).where(f"x <= y and not ({alone}) and 100 * x_most >= {percent} * y_least and 100 * y_most >= {percent} * x_least").select("g", "x", "y")
    ends = stage(pairs.select("g", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")), "block-pairs")
    return out.unionByName(placed.select("g", "rid", "comp", "pos", "block").join(small(ends), ["g", "block"]).select("g", "x", "y", "rid", "comp", "pos", "block"))


def _joined(rows: DataFrame, comps: DataFrame | None, reps: DataFrame, percent: int, across: bool) -> DataFrame:
    """Verified links (a, b), staged, among rows (g, rid, n, pos, comp) of equal g; comps (rid, component) holds their components.

    The rows' bitmaps and sets are in reps (rid, n, bits, grams).
    """
    kept = stage(_shared(rows, percent), "shared-keys")
    dealt = _dealt(kept, percent, across)
    if small(kept, MOST_SENT) is not kept:
        dealt = F.broadcast(dealt)
    clusters = stage(components(_promising(reps.select("rid", "n", "bits").join(dealt, "rid"), percent)), "clusters")
    members = clusters.select(F.col("node").alias("rid"), F.col("component").alias("g")).join(reps.select("rid", "n"), "rid").withColumn("pos", F.lit(0))
    members = members.withColumn("comp", F.col("rid")) if comps is None else members.join(small(comps), "rid", "left").withColumn("comp", F.coalesce("component", "rid"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks")
    members = stage(members.select("g", "rid", "n", "pos", "comp"), "members")
    tasks = _dealt(members.join(members.groupBy("g").agg(blocks), "g"), percent, across)
    if small(members, MOST_SENT) is not members:
        tasks = F.broadcast(tasks)
    return stage(_links(reps.select("rid", "grams").join(tasks, "rid"), percent), "links")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(row_id, doc_id, th, n_shingles, component, component_id) per row of docs (doc_id, text; more columns are ignored).

    Words are runs outside ASCII white space, A-Z lowered. Two documents link when
    100 * |intersection| >= percent * |union| of their sets of distinct k-word shingles; fewer words make one
    shingle. Null, empty and blank texts have no shingles and stay alone. component_id is the smallest doc_id
    reachable; a null doc_id never is the smallest unless a component has no other. component is a number of the
    component's own, also where component_id is null. row_id tells rows of equal
    doc_id apart; th is xxhash64 of the text. Equal rows link like any copies. No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, k))
    sets = stage(set_table(docs, k, percent, shared).withColumn("rid", F.monotonically_increasing_id()), "sets")  # from here on row ids are fixed
    shared.destroy()
    full = sets.where("n > 0")
    class_keys = ["k1", "k2", "n"]
    classes = stage(full.groupBy(*class_keys).agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least_id")), "classes")
    copies = stage(full.select("rid", *class_keys).join(classes.select(*class_keys, F.col("rid").alias("rep")), class_keys).where("rid <> rep").select("rid"), "copies")
    reps = full.join(small(copies), "rid", "left_anti")

    near = reps.select("rid", "n", F.col("rid").alias("comp"), F.posexplode("mins").alias("i", "m")).select(F.xxhash64("i", "m").alias("g"), "rid", "n", F.lit(0).alias("pos"), "comp")
    links = _joined(near, None, reps, percent, False)
    comps = stage(components(links), "near-components")
    named = comps.withColumnRenamed("node", "rid")
    rows = reps.select("rid", "n", "prefix").join(small(named), "rid", "left").select("rid", "n", F.coalesce("component", "rid").alias("comp"), F.posexplode("prefix").alias("pos", "g"))
    more = _joined(rows, named, reps, percent, True)

    final = stage(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    linked = stage(classes.join(final.withColumnRenamed("node", "rid"), "rid", "left").select(*class_keys, "least_id", F.coalesce("component", "rid").alias("comp")), "linked")
    ids = linked.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(ids, "comp").select(*class_keys, "comp", "component_id")
    out = sets.select("rid", "doc_id", "th", "n", "k1", "k2").join(linked, class_keys, "left")
    return out.select(F.col("rid").alias("row_id"), "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("rid")).alias("component"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
