"""Decisions about documents, brought back to whole rows.

A row is known by its id and the hash of its text; equal keys are rows that no operator can tell apart. Decision
tables are small against the texts, and rows only move when such a table is too large for a checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small

KEYS = ["_row_id", "_row_text"]


def row_keys(doc_id: Column, text_hash: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("string"), F.lit("")).alias(KEYS[0]), text_hash.alias(KEYS[1])]


def keyed(docs: DataFrame) -> DataFrame:
    """(d, KEYS): whole rows as structs, so that no name of theirs clashes with those used here."""
    return docs.select(F.struct("*").alias("d"), *row_keys(F.col("doc_id"), F.xxhash64("text")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose keys are in gone, a staged table of distinct KEYS."""
    return keyed(docs).join(small(gone), KEYS, "left_anti").select("d.*")


def counted(docs: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """docs with column name, which replaces one of that name: of rows with equal keys, counts (KEYS, total, rows) says how to share total among rows.

    Each gets total div rows, and the first total mod rows of them one more. counts is a staged table with one row
    for each key of docs.
    """
    joined = keyed(docs.drop(name)).join(small(counts), KEYS)
    even = joined.where("total % rows = 0").select("d.*", F.expr("total div rows").alias(name))
    if not counts.where("total % rows <> 0").limit(1).count():
        return even
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.lit(0)))
    rest = joined.where("total % rows <> 0").withColumn("place", place)
    return even.unionByName(rest.select("d.*", F.expr("total div rows + cast(place <= total % rows as int)").alias(name)))
