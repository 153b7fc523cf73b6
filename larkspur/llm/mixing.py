"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r in [0, MOST_COPIES]. Among all rates that give every source its target number of words,
those closest in relative entropy to rate 1 are exponential tilts: the odds r / (MOST_COPIES - r) are those of rate 1
times exp(lambda_source * size / mean size). The lambdas solve the convex dual, one gradient entry for each source's
word constraint, with a diagonal Hessian; Newton steps for all sources at once are distributed aggregates over the
histogram of (source, size). Rates then become whole copies: bins of equal (source, size), the largest sizes first,
take the number of copies that keeps the running total of words at its target, and copies are dealt evenly within a
bin, so that a source misses its target by about one of its smallest documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small, stage

MOST_COPIES = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of one bin and salt that a window sorts together, about.
SALT_ROWS = 200_000
NEWTON_ROUNDS = 60
TOLERANCE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(key, size, target) from (key, size): weights repeat over the sources in the order of key.

    Targets are at most most * size; what is over goes to the others by weight until none is above. Sources are
    numbered by sorted ranges, so no task holds them all.
    """
    spark = sources.sparkSession
    parts = max(1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ranged = stage(sources.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("id", 33)
    before, offset = {}, 0
    for p, n in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # one row for each partition
        before[p], offset = offset, offset + n
    if not before:
        return ranged.select("key", "size", F.lit(0.0).alias("target"))
    starts = F.create_map(*[F.lit(int(x)) for kv in before.items() for x in kv])
    index = starts[part.cast("int")] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    weighted = stage(ranged.select("key", "size", F.array(*[F.lit(w) for w in weights])[F.pmod(index, F.lit(len(weights))).cast("int")].alias("w")), "weights")
    total = weighted.agg(F.sum("size")).first()[0] or 0
    level, capped = None, F.lit(False)
    while True:
        row = weighted.agg(F.sum(F.when(capped, F.col("size") * most).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        new = (total - row[0]) / row[1] if row[1] else 0.0
        if level is not None and new <= level * (1 + 1e-15):
            break
        level = new
        capped = F.col("w") * F.lit(level) > F.col("size") * most
    return stage(weighted.select("key", "size", F.when(capped, (F.col("size") * most).cast("double")).otherwise(F.col("w") * level).alias("target")), "targets")


def _rate(tilt: Column) -> Column:
    """Rate between 0 and MOST_COPIES whose odds are those of rate 1 times exp(tilt)."""
    return MOST_COPIES / (1 + (MOST_COPIES - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt))))


def newton(bins: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, lam, mean) for bins (key, size, n) with sizes of 1 and more and targets (key, target).

    Safeguarded by a bracket; a target of 0 or of all copies gives an infinite tilt.
    """
    means = bins.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("size") * F.col("n")).alias("all"))
    state = stage(means.join(targets.select("key", "target"), "key").select("key", "mean", "all", "target", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done")), "newton")
    x = F.col("size") / F.col("mean")
    for _ in range(NEWTON_ROUNDS):
        rate = _rate(F.col("lam") * x)
        step = bins.join(small(state.select("key", "lam", "mean")), "key").select("key", (F.col("n") * F.col("size") * rate).alias("g"), (F.col("n") * F.col("size") * x * rate * (1 - rate / MOST_COPIES)).alias("h"))
        sums = step.groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        miss = F.col("g") - F.col("target")
        done = (F.abs(miss) <= TOLERANCE * (F.col("target") + 1)) | (F.col("hi") - F.col("lo") < 1e-12)
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        free = F.when(F.col("h") > 0, F.col("lam") - miss / F.col("h"))
        moved = state.join(sums, "key").select("key", "mean", "all", "target", "lam", lo.alias("lo"), hi.alias("hi"), free.alias("free"), done.alias("done"))
        inside = F.col("free").isNotNull() & (F.col("free") > F.col("lo")) & (F.col("free") < F.col("hi"))
        # outside the bracket: 0 first, then its middle on a scale that grows from 1
        wide = F.when((F.col("lo") <= -1e4) & (F.col("hi") < 1e4), F.col("hi") * 2 - 1).when((F.col("hi") >= 1e4) & (F.col("lo") > -1e4), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = stage(moved.select("key", "mean", "all", "target", F.when(F.col("done"), F.col("lam")).when(inside, F.col("free")).otherwise(wide).alias("lam"), "lo", "hi", "done"), "newton")
        if not state.where("not done").where((F.col("target") > 0) & (F.col("target") < F.col("all") * MOST_COPIES * (1 - 1e-12))).limit(1).count():
            break
    lam = F.when(F.col("target") >= F.col("all") * MOST_COPIES * (1 - 1e-12), F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.col("lam"))
    return state.select("key", lam.alias("lam"), "mean")


def _round_bins(rows: pd.DataFrame) -> pd.DataFrame:
    """Copies for each bin of one source, the largest sizes first: the running total of words follows the rates.

    One source's distinct sizes come together, not its documents; their number is bounded by its longest text.
    """
    rows = rows.sort_values("size", ascending=False)
    copies, due, taken = [], 0.0, 0
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
        due += n * size * rate
        k = min(int(n) * MOST_COPIES, max(0, int((due - taken) / size + 0.5)))
        taken += k * int(size)
        copies.append(k)
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "copies": copies})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs: doc_id, th (xxhash64 of text), size, source_size, target, taken, copies.

    size counts runs outside ASCII white space (null: 0). Sources are ordered by code point, a null source is a
    source of its own and comes last; weights repeat over them; all targets together are the words of docs, each at
    most MOST_COPIES times its source's. Rows without words take 0 words and have 1 copy. Ties between rows of equal
    source and size are broken by a hash of doc_id, so reruns agree; rows that are equal in full may swap places,
    which changes nothing. No rows give no rows.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), key.alias("key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", F.lit(11)).alias("rank"))
    rows = stage(rows, "sizes")
    salts = max(64, rows.count() // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod("rank", F.lit(salts)))
    parts = stage(rows.groupBy("key", "size", "salt").agg(F.count("*").alias("n")), "salted-bins")
    bins = stage(parts.groupBy("key", "size").agg(F.sum("n").alias("n")), "bins")
    targets = source_targets(bins.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("size")), weights)
    some = bins.where("size > 0")
    lam = newton(some, targets)
    rate = F.when(F.isnan("lam") | (F.abs("lam") == float("inf")), F.when(F.col("lam") > 0, float(MOST_COPIES)).otherwise(0.0)).otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean")))
    rated = some.join(small(lam), "key").select("key", "size", "n", rate.alias("rate"))
    plan = stage(rated.groupBy("key").applyInPandas(_round_bins, "key string, size long, copies long"), "copies")

    # the copies of a bin over its salts, in proportion to their rows
    whole = bins.withColumnRenamed("n", "all").join(plan, ["key", "size"], "left")
    running = F.sum("n").over(Window.partitionBy("key", "size").orderBy("salt"))
    share = parts.withColumn("upto", running).join(whole, ["key", "size"])
    upto, before = F.expr("(upto * copies) div all"), F.expr("((upto - n) * copies) div all")
    share = stage(share.select("key", "size", "salt", "n", (upto - before).alias("k")), "shares")
    place = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy("rank", "doc_id"))
    dealt = rows.withColumn("place", place).join(share, ["key", "size", "salt"])
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("k div n") + (F.col("place") <= F.expr("k % n")).cast("long"))
    out = dealt.withColumn("copies", copies).join(small(targets.select("key", F.col("size").alias("source_size"), "target")), "key")
    return out.select("doc_id", "th", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))
