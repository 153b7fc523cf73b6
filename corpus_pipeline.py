"""A corpus pipeline over documents: quality, near duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its predecessor kept, and
its result is written as Parquet and read back as the next stage's docs. Tables that a stage needs on the way are
deleted before it returns, but for its list of decisions.

For every stage: null and empty texts are texts without words, long ones are read whole, rows that are equal in id and
text are told apart by nothing and so are dealt with as a number of rows, further columns pass through whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, jaccard_join, mixing, quality_rules, rows, secret_scan
from larkspur.llm.scratch import bounded_batches, mark, release, stage

#: Word shingles and similarity (percent) of the near-duplicate stage.
SHINGLE, SIMILAR = 5, 80
QUALITY_CUT = 0.7
#: A column that near_duplicates adds for a while; documents may not have one of this name.
STAYS = "larkspur near duplicate stays"

#: Learned rules, iterated components and rounded mixtures are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores QUALITY_CUT or more; the others go."""
    bounded_batches(spark)
    model = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.where(quality_rules.score(F.col("text"), model) >= QUALITY_CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id. Texts without words are groups of their own."""
    bounded_batches(spark)
    since = mark()
    found = stage(jaccard_join.jaccard_components(docs, SHINGLE, SIMILAR), "groups")
    leaders = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row_id").alias("row_id"))
    marked = found.join(leaders.select("row_id", F.lit(1).alias("stays")), "row_id", "left")
    totals = marked.groupBy(*rows.row_keys(F.col("doc_id"), F.col("th"))).agg(F.count("stays").alias("stays"), F.count("*").alias("rows"))
    totals = stage(totals, "decisions")
    gone = stage(totals.where("stays = 0").select(*rows.KEYS), "gone")
    # rows equal in id and text of which some stay
    some = stage(totals.where("stays between 1 and rows - 1").select(*rows.KEYS, F.col("stays").alias("total"), "rows"), "repeated")
    release(since, keep=(gone, some))
    out = rows.without(docs, gone)
    if some.limit(1).count():
        part = rows.counted(docs, some, STAYS).where(F.col(STAYS) == 1).drop(STAYS)
        out = rows.without(out, some.select(*rows.KEYS)).unionByName(part)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; the others go."""
    bounded_batches(spark)
    since = mark()
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    gone = stage(found.select(*rows.row_keys(F.col("doc_id"), F.col("th"))).distinct(), "contaminated")
    release(since, keep=(gone,))
    return rows.without(docs, gone)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced by a mark."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents with the number of copies that it takes, 1 to 3; those it takes none of go. A column copies is replaced."""
    bounded_batches(spark)
    since = mark()
    taken = mixing.mix(docs)
    counts = taken.groupBy(*rows.row_keys(F.col("doc_id"), F.col("th"))).agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    counts = stage(counts, "copies")
    release(since, keep=(counts,))
    return rows.counted(docs, counts, "copies").where("copies > 0")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", secrets),
    ("mix", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
