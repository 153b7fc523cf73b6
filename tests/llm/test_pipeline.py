import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from larkspur.llm.scratch import stage

D = "/root/testdata/sf0.001"


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _leaders(rows):
    """doc_ids that stay: the smallest of each group linked by 5-word shingles of Jaccard similarity 0.8 and more."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _low(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        least[g] = r.doc_id if g not in least else min(least[g], r.doc_id)
    return least.values()


def _windows(text, n=None):
    """Runs of n words; of a benchmark item (no n) of 10, or all of its words where it has fewer."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(text))
    n = n or min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema))
    columns = docs.columns
    for name, apply in pipeline.STAGES:
        before = docs
        docs = stage(apply(spark, before, D), name)
        ids = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        was = collections.Counter(r.doc_id for r in before.select("doc_id").collect())
        assert not ids - was
        if name != "mix":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert max(ids.values()) == 1 and ids == collections.Counter(_leaders(before.collect()))
        if name == "decontaminate":
            items = {w for r in spark.read.parquet(f"{D}/benchmark.parquet").collect() for w in _windows(r.text)}
            assert ids == collections.Counter(r.doc_id for r in before.collect() if not any(w in items for n in {len(w) for w in items} for w in _windows(r.text, n)))
        if name == "secrets":
            assert ids == was
            assert not [r for r in docs.collect() if re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r.text or "")]
        if name == "mix":
            assert all(1 <= r.copies <= 3 for r in docs.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, apply in pipeline.STAGES:
        docs = stage(apply(spark, docs, D), "nothing")
    assert docs.count() == 0


def test_stages_with_clashing_columns_and_a_long_text(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    clash = ["score", "total", "rows", "copies", "place", "d", "_row_id", "_row_text", "_secret_spans", "_stays", "all", "rid", "component", "n", "s", "x"]
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    docs = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(10**9, long, "en", "s", len(long)), (10**9 + 1, long, "en", "s", len(long))], docs.schema))
    docs = docs.unionByName(docs.where("doc_id = 0")).select("*", *[F.lit(f"own {c}").alias(c) for c in clash])
    columns = docs.columns
    for name, apply in pipeline.STAGES:
        docs = stage(apply(spark, docs, D), name)
        if name != "mix":
            assert docs.columns == columns
            assert all(r[c] == f"own {c}" for r in docs.limit(5).collect() for c in clash)
        assert docs.where("doc_id = 1000000001").count() == 0 or name == "quality"
    assert sorted(docs.columns) == sorted(columns) and set(dict(docs.dtypes)[c] for c in ("copies",)) == {"bigint"} and docs.count() > 0
