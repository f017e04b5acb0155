"""Event-time windows: the same expressions over a table and over a watermarked stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LATENESS = "1 hour"


def timed(df: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events with ts as a timestamp; a stream gets a watermark and drops what is later than that."""
    out = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", lateness) if df.isStreaming else out


def windowed(df: DataFrame, window: Column, *keys: str) -> DataFrame:
    """Number and sum of values per window and keys."""
    out = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("stop"), *keys, "n", "total")


def tumbling(df: DataFrame, length: str, *keys: str) -> DataFrame:
    return windowed(timed(df), F.window("ts", length), *keys)


def sliding(df: DataFrame, length: str, step: str, *keys: str) -> DataFrame:
    return windowed(timed(df), F.window("ts", length, step), *keys)


def sessions(df: DataFrame, gap: str, *keys: str) -> DataFrame:
    return windowed(timed(df), F.session_window("ts", gap), *keys)


def ended(df: DataFrame, length: str) -> DataFrame:
    """The events and one row more, so far behind the last one that its watermark closes every window (or gap) of that length before it.

    The row's own window holds no event and is never closed, so a stream doesn't append it.
    """
    end = F.max("ts")
    for step in (length, LATENESS, "1 second"):
        end = end + F.expr(f"INTERVAL {step}")
    return df.unionByName(df.agg(end.alias("ts")), allowMissingColumns=True)


def read_stream(spark, path: str, schema, files_per_batch: int | None = 8) -> DataFrame:
    """A folder of Parquet files as a stream; None: all files that are there are one batch, so none of their rows is late."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
