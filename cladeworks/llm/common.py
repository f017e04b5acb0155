"""Small helpers shared by the operators: table access, stage cuts, Arrow group streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.sources.stages import staged, unstaged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables with Spark's own reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    """The column as a string, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The result has no lineage before the written files, so it survives lost executors
    and is computed once however often it is used. All such tables of an application lie in one folder, which
    `cladeworks.sources.stages.clear` deletes; dropped() deletes one of them.
    """
    return staged(df, label)


def dropped(df: DataFrame) -> None:
    """Delete the table behind a frame from cut() that nothing reads any more."""
    unstaged(df)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def runs(
    batches: Iterable[pa.RecordBatch], keys: Sequence[str], most_rows: int = 4000
) -> Iterator[pa.Table]:
    """Regroup a stream of batches, sorted by keys, into tables of whole key runs.

    Each table holds one or more complete runs, about most_rows rows unless one run is longer.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most_rows:
            continue
        whole = pa.Table.from_batches(held)
        last = last_run_start(whole, keys)
        if last == 0:
            continue
        yield whole.slice(0, last)
        held = whole.slice(last).to_batches()
        rows = whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def last_run_start(whole: pa.Table, keys: Sequence[str]) -> int:
    """Row at which the last run of equal keys begins (binary search; rows are sorted by keys)."""
    columns = [whole.column(k) for k in keys]
    end = whole.num_rows - 1
    final = [c[end].as_py() for c in columns]
    low, high = 0, end
    while low < high:
        mid = (low + high) // 2
        if [c[mid].as_py() for c in columns] == final:
            high = mid
        else:
            low = mid + 1
    return low
