"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins carry no broadcast hints: Spark broadcasts a side only when its measured size is under the
# threshold, and splits skewed partitions of shuffled joins at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "emporia", **extra: str) -> SparkSession:
    """A session with the recommended settings; `extra` uses `_` for `.` in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
