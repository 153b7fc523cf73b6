"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Spark deletes a query's shuffle files when the query ends, instead of when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the setting is absent, one of our own in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted by release() or when the driver ends."""
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    A lost executor then costs only the tasks it ran, since no later step recomputes what stands above. The shuffle
    files of the write are deleted at its end.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(schema).parquet(path)


def small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """df, a staged table, marked for broadcast if its stored files are proven to be small; else as it is.

    Compressed integers grow less than tenfold in memory.
    """
    size = sum(stored_bytes(df.sparkSession, f) for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return broadcast(df) if size <= most_bytes else df


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path, as the file system that holds it tells."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0


def mark() -> int:
    """A point to which release() can go back."""
    return len(_made)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written, which it does when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows of whole texts go to Python workers in batches, whose size bounds the workers' memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(rows, int(spark.conf.get(key))))


def release(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the intermediate tables made since mark() but for those that the tables of keep are read from."""
    kept = {f for df in keep for f in df.inputFiles()}
    gone, _made[since:] = _made[since:], []
    for spark, path in reversed(gone):
        if any(path.rsplit("/", 1)[1] in f for f in kept):
            _made.append((spark, path))
            continue
        try:
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner cleans up then
            continue


atexit.register(release)
