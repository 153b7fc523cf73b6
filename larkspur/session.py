"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI semantics give typed errors and three-valued logic; UTC fixes date arithmetic; AQE sizes and splits shuffles.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "larkspur", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; keyword names use _ for dots."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for k, v in more.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()
