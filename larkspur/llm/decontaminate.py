"""Benchmark decontamination by winnowing.

Fingerprints: of each SPAN - GRAM + 1 consecutive hashes of word GRAM-grams the smallest (rightmost of equals) is
kept, so every shared span of SPAN words has a fingerprint in both texts. Fingerprints of documents and items are
joined, and each hit carries the hashes of the words around it, with which it is extended to the whole shared run;
only runs of SPAN words count. Items of fewer words have one window, compared as a whole.

Word hashes have 64 bits; GRAM = 5, SPAN = 10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import ALNUM, U, gram_hashes, mix, signed, text_chunks, word_hashes
from .scratch import stage

GRAM = 5
SPAN = 10
#: Item fingerprints up to this many (8 bytes each) are sent to the tasks, which then emit only fingerprints that
#: occur in an item. With more, all fingerprints of the documents go into the join; the result is the same.
FILTER_MOST = 2_000_000
#: Hits of one fingerprint are dealt over so many partitions.
SALTS = 16

_BACK, _AHEAD = SPAN - GRAM, SPAN
_STRUCT = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("around", pa.list_(pa.int64()))])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest of each width consecutive hashes, the rightmost of equals, each once."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        take = hashes[j : j + n] <= best
        best = np.where(take, hashes[j : j + n], best)
        at = np.where(take, np.arange(j, j + n), at)
    return np.unique(at)


def _fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of a text's fingerprints."""
    grams = gram_hashes(words, GRAM)
    at = winnow(grams, SPAN - GRAM + 1)
    return at, grams[at]


def _around(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words from _BACK before to _AHEAD after each position; 0 or 1 outside the text."""
    padded = np.concatenate([np.zeros(_BACK, U), words, np.zeros(_AHEAD, U)])
    return padded[at[:, None] + np.arange(_BACK + _AHEAD)[None, :]]


def _whole(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows of n words, apart from the hashes of GRAM-grams."""
    return mix(gram_hashes(words, n) ^ U(0xA5A5A5A5 + n))


def item_prints(bench: DataFrame) -> DataFrame:
    """(fp, length, pos, around, item_id): fingerprints of items; length below SPAN: one whole short item."""

    def run(batches):
        for batch in batches:
            for first, data, off in text_chunks(batch.column("text")):
                words, cut = word_hashes(data, off, ALNUM)
                ids = batch.column("item_id")
                rows = {"fp": [], "length": [], "pos": [], "around": [], "item_id": []}
                for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    w = words[s:e]
                    if len(w) >= SPAN:
                        at, fp = _fingerprints(w)
                        around = signed(_around(w, at)).tolist()
                        length = SPAN
                    elif len(w):
                        at, fp, around, length = np.zeros(1, np.int64), _whole(w, len(w)), [None], len(w)
                    else:
                        continue
                    rows["fp"] += signed(fp).tolist()
                    rows["pos"] += at.tolist()
                    rows["around"] += around
                    rows["length"] += [length] * len(at)
                    rows["item_id"] += [ids[first + i].as_py()] * len(at)
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("fp", pa.int64()), ("length", pa.int32()), ("pos", pa.int32()), ("around", pa.list_(pa.int64())), ("item_id", pa.string())]))

    return bench.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "fp long, length int, pos int, around array<long>, item_id string")


def _document_prints(docs: DataFrame, lengths: list[int], known: np.ndarray | None) -> DataFrame:
    """(doc_id, th, n_words, hits): per document the fingerprints that may occur in an item."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        table = None if shared is None else shared.value

        def may_occur(fp: np.ndarray) -> np.ndarray:
            if table is None:
                return np.arange(len(fp))
            return np.flatnonzero(table[np.minimum(np.searchsorted(table, fp), len(table) - 1)] == fp) if len(table) else np.zeros(0, np.int64)

        for batch in batches:
            for first, data, off in text_chunks(batch.column("text")):
                words, cut = word_hashes(data, off, ALNUM)
                # grams over the whole chunk; those across two documents are left out below
                grams = gram_hashes(words, GRAM)
                row_of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                hit_row, hit_pos, hit_fp, hit_around = [], [], [], []
                if table is None:
                    for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                        at, fp = _fingerprints(words[s:e])
                        hit_row.append(np.full(len(at), i))
                        hit_pos.append(at)
                        hit_fp.append(fp)
                        hit_around += signed(_around(words[s:e], at)).tolist()
                elif len(grams):
                    # a gram that no item has as a fingerprint need not be winnowed at all
                    maybe = may_occur(grams)
                    for i in np.unique(row_of[maybe]):
                        s, e = cut[i], cut[i + 1]
                        at, fp = _fingerprints(words[s:e])
                        ok = may_occur(fp)
                        at, fp = at[ok], fp[ok]
                        hit_row.append(np.full(len(at), i))
                        hit_pos.append(at)
                        hit_fp.append(fp)
                        hit_around += signed(_around(words[s:e], at)).tolist()
                for n in lengths:
                    whole = _whole(words, n)
                    start = np.arange(len(whole))
                    inside = row_of[start] == row_of[start + n - 1] if len(whole) else np.zeros(0, bool)
                    at = start[inside]
                    at = at[may_occur(whole[at])]
                    hit_row.append(row_of[at])
                    hit_pos.append(at - cut[row_of[at]])
                    hit_fp.append(whole[at])
                    hit_around += [None] * len(at)
                rows = len(cut) - 1
                row = np.concatenate(hit_row).astype(np.int64) if hit_row else np.zeros(0, np.int64)
                pos = np.concatenate(hit_pos) if hit_row else row
                fp = np.concatenate(hit_fp).astype(U) if hit_row else row.view(U)
                order = np.argsort(row, kind="stable")
                values = pa.StructArray.from_arrays([pa.array(signed(fp[order])), pa.array(pos[order].astype(np.int32)), pa.array([hit_around[i] for i in order], pa.list_(pa.int64()))], fields=list(_STRUCT))
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(rows + 1)).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), batch.column("th").slice(first, rows), pa.array(np.diff(cut), pa.int64()), hits], names=["doc_id", "th", "n_words", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_words long, hits array<struct<fp:long,pos:int,around:array<long>>>")


def _extended(pairs: DataFrame) -> DataFrame:
    """(rid, item_id, s, e): the run that each hit extends to, where it is long enough."""

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            pos = batch.column("pos").to_numpy().astype(np.int64)
            s, e = pos.copy(), pos + length
            keep = np.ones(len(pos), bool)
            long = np.flatnonzero(length == SPAN)
            if len(long):
                sides = [np.stack(batch.column(c).take(pa.array(long)).flatten().to_numpy().reshape(len(long), -1)) for c in ("around", "item_around")]
                same = (sides[0] == sides[1]) & (sides[0] != 0)
                back = np.cumprod(same[:, _BACK - 1 :: -1], axis=1).sum(axis=1)
                ahead = np.cumprod(same[:, _BACK:], axis=1).sum(axis=1)
                s[long], e[long] = pos[long] - back, pos[long] + ahead
                keep[long] = (ahead >= GRAM) & (back + ahead >= SPAN)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("rid").filter(mask), batch.column("item_id").filter(mask), pa.array(s[keep].astype(np.int32)), pa.array(e[keep].astype(np.int32))], names=["rid", "item_id", "s", "e"])

    return pairs.mapInArrow(run, "rid long, item_id string, s int, e int")


def contamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, th (xxhash64 of the text), n_words, n_hit, items (sorted strings), n_items.

    Words are runs of 0-9, a-z (A-Z lowered) and characters outside ASCII, of whole texts. A window is SPAN
    consecutive item words; an item of fewer words, but not none, is one window. A document word inside any
    occurrence of a window is hit. Null and empty texts have no words; null or repeated ids, repeated texts and
    more columns change nothing: each row counts for itself, and items of equal id count once. An item without an
    id marks words but isn't listed. No rows give no rows, an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    prints = stage(item_prints(bench.select("item_id", "text")), "item-prints")
    lengths = sorted(r[0] for r in prints.where(F.col("length") < SPAN).select("length").distinct().collect())  # at most SPAN - 1
    distinct = prints.select("fp").distinct()
    known = None
    if distinct.limit(FILTER_MOST + 1).count() <= FILTER_MOST:
        known = np.sort(distinct.toPandas()["fp"].to_numpy().astype(np.int64).view(U))
    found = stage(_document_prints(docs.select("doc_id", "text"), lengths, known).withColumn("rid", F.monotonically_increasing_id()), "document-prints")
    hits = found.select("rid", F.explode("hits").alias("h")).select("rid", "h.fp", "h.pos", "h.around", F.pmod(F.xxhash64("rid", "h.pos"), F.lit(SALTS)).alias("salt"))
    items = prints.select("fp", "length", F.col("around").alias("item_around"), "item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    runs = _extended(hits.join(items, ["fp", "salt"]).select("rid", "pos", "around", "length", "item_around", "item_id"))
    spans = runs.groupBy("rid").agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("item_id").alias("items"))

    def add(acc, x):
        return F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to"))

    union = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), add)["n"]
    counted = spans.select("rid", union.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    return found.select("rid", "doc_id", "th", "n_words").join(counted, "rid", "left").select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
