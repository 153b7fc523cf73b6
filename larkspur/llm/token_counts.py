"""Token counts with a digest cache.

A text's count depends on its bytes and the tokenizer's version alone, so counts are stored under (digest of the text,
digest of the tokenizer's file). Texts whose digest is stored aren't encoded; of equal texts one is. New counts are
appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import new_path, small, stage, stored_bytes

#: Texts are handed to the library in groups of about so many characters.
GROUP_CHARS = 200_000
CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType())])

_loaded: dict[str, Callable] = {}


def tokenizer_version(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def counter(data: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens as the library gives them, without begin, end or added special tokens; made once a process.

    kind: json for tokenizers, model for sentencepiece. Special strings inside texts are handled as the library does
    by default; nothing is cut or padded.
    """
    version = tokenizer_version(data)
    if version not in _loaded:
        if kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(data.decode("utf-8"))
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[version] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        elif kind == "model":
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=data)
            _loaded[version] = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"unknown kind of tokenizer: {kind}")
    return _loaded[version]


def _encoded(rows: DataFrame, data: bytes, kind: str) -> DataFrame:
    """(digest, version, n_tokens) of rows (digest, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(data)  # the tokenizer's file, a few MB
    version = tokenizer_version(data)

    def run(batches):
        count = counter(shared.value, kind)
        for batch in batches:
            out, some, chars = [], [], 0
            for text in batch.column("text"):
                some.append(text.as_py())
                chars += len(some[-1])
                if chars >= GROUP_CHARS:
                    out += count(some)
                    some, chars = [], 0
            out += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(out), pa.string()), pa.array(out, pa.int64())], names=["digest", "version", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def token_counts(docs: DataFrame, data: bytes, kind: str = "json", limit: int = 1024, cache: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    data: the tokenizer's file. cache: a folder all executors reach; by default a fresh one in the shared folder.
    A null text counts as empty (0 bytes, 0 tokens); repeated rows and ids, and null ids, each keep their row; more
    columns are ignored; no rows give no rows.

    Texts move only if neither the rows to encode nor the rows to leave out fit in a checked broadcast.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-cache")
    version = tokenizer_version(data)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    keyed = stage(rows.drop("text"), "digests")
    wanted = keyed.groupBy("digest").agg(F.min("owner").alias("owner"))
    if stored_bytes(spark, cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
        wanted = wanted.join(known.select("digest"), "digest", "left_anti")
    take = stage(wanted, "to-encode")
    # joins stand in stages of their own, where Spark can split a digest of very many rows
    marked = stage(keyed.join(take.select("digest", F.col("owner").alias("first")), "digest", "left"), "marked")
    skip = stage(marked.where("first is null or first <> owner").select("digest", "owner").distinct(), "known")
    if small(take) is not take:
        misses = rows.join(small(take), ["digest", "owner"], "left_semi")
    elif small(skip) is not skip:
        misses = rows.join(small(skip), ["digest", "owner"], "left_anti")
    else:
        misses = rows.join(take, ["digest", "owner"], "left_semi")
    _encoded(misses, data, kind).write.mode("append").parquet(cache)
    counts = stage(spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
