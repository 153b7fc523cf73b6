"""Streams of changes applied to versioned tables, in order and once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.versioned import VersionedTable


def apply_batch(table: VersionedTable, changes: DataFrame, batch: int, stream: str = "changes") -> int | None:
    """Commit a batch of changes (pk, seq, op, columns of the table); None if this or a later batch of the stream is in.

    Of each key the change of the highest seq counts, also against what earlier batches committed under that key: a
    batch only holds later changes of a key than those before it, since files arrive in order.
    """
    done = max((m["batch"] for m in table.manifests().values() if m.get("stream") == stream), default=-1)
    if batch <= done:
        return None
    row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])
    last = changes.groupBy("pk").agg(F.max_by(F.struct("op", row.alias("row")), "seq").alias("v")).select(F.col("pk").cast("string").alias("pk"), "v.op", "v.row")
    with table.begin() as t:
        t.apply(last)
        return t.commit({"stream": stream, "batch": batch})


def apply_changes(stream: DataFrame, table: VersionedTable, checkpoint: str, name: str = "changes", available_now: bool = True):
    """Start a query that commits each micro-batch once: a batch that runs again after a failure is known by its number."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: apply_batch(table, df, batch, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_schema(schema: T.StructType) -> T.StructType:
    """(pk, seq, op, columns) of a table's changes."""
    return T.StructType([T.StructField("pk", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *schema.fields])
