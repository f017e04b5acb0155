"""A session with the settings that the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cladeworks", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """Build or get a session: UTC, adaptive execution, Arrow; anything else by keyword (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    wanted |= {k.replace("__", "."): v for k, v in settings.items()}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
