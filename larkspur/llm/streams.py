"""Groups of a sorted partition, read batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_groups(df: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of equal keys side by side in one partition, sorted by keys and then order.

    The number of partitions is the session's, given here so that adaptive execution doesn't merge them: what
    follows works in Python, whose cost the bytes of its input don't tell.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables, each of whole groups: whatever may go on in the next batch is held back.

    Memory: one batch and the longest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        same = all(batch.column(k)[0].as_py() == batch.column(k)[-1].as_py() for k in keys)
        if same and all(held[0].column(k)[0].as_py() == batch.column(k)[-1].as_py() for k in keys):
            continue
        table = pa.Table.from_batches(held)
        cut = int(bounds(table, keys)[-2])
        held = table.slice(cut).combine_chunks().to_batches()
        yield table.slice(0, cut).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins, and the end."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k)
        values = column.to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def binary_parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off
