"""Streams of events: windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, most_files: int = 8) -> DataFrame:
    """Events from Parquet files as they arrive, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their types by tumbling window; rows later than the watermark are dropped in a stream."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")
