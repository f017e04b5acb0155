"""Sinks that hold every row once, whatever fails in between.

A batch of a stream may be run again after a failure, with the same number and the same rows. So it is written into a folder of its number, and
written again over what an earlier try has left there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], None]


def write_batch(rows: DataFrame, number: int, path: str) -> None:
    """Keep a batch under its number: another try replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows that batches have written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run(frame: DataFrame, path: str, checkpoint: str, mode: str = "append", handlers: Mapping[str, Handler] | None = None) -> StreamingQuery:
    """Start a stream that keeps its batches under path and hands the rows of each kind (a column) to its handler, with the batch's number.

    A batch is done when it is kept and no handler has failed. If one fails, the others still get their rows, then the query ends with its error; started
    again, it runs the whole batch anew. So handlers see a batch once or more, always under the same number, by which they can tell a repeat.
    """

    def batch(rows: DataFrame, number: int) -> None:
        write_batch(rows, number, path)
        failed = []
        kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={number}") if handlers else None
        for kind, handler in (handlers or {}).items():
            try:
                handler(kept.where(kept["kind"] == kind), number)
            except Exception as error:  # a handler is foreign code: the others get their rows before this is raised
                failed.append(error)
        if failed:
            raise failed[0]

    return frame.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
