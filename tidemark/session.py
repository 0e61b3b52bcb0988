"""Sessions: UTC, ANSI and adaptive execution always on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoints go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; master and sizes come from the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | more
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
