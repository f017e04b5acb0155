"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one, a folder of this machine if the session runs on it alone, as in tests; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/cladeworks-checkpoints"


def stage_root(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this application."""
    return f"{shared_dir(spark)}/cladeworks/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there, and it is computed once."""
    path = f"{stage_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def unstaged(df: DataFrame) -> None:
    """Delete the table behind a staged frame that nothing reads any more, such as the round before in a loop."""
    if path := getattr(df, "_staged_at", None):
        removed(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that were not written yet can't be read afterwards."""
    removed(spark, stage_root(spark))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle behind: the files of each query go when it is over."""
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANED, before)
