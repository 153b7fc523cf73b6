"""Folders for tables that queries make on their way, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; without the setting one of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/larkspur/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def release() -> None:
    """Delete the folders made."""
    while _made:
        spark, path = _made.pop()
        try:
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner cleans up then
            continue


atexit.register(release)
