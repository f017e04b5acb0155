"""Linear recurrences x -> a * x + b along an order, split between tasks.

Two steps one after the other are again such a step: (a, b) then (c, d) is (c * a, c * b + d). So rows are range-partitioned by
group and order, each task composes what it holds of a group into one step, and the few steps of a group are applied in turn. A group that has all rows is
shared by all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composed(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """All steps in turn as one."""
    later = np.append(np.cumprod(a[::-1])[::-1][1:], 1.0)  # what the steps behind each one multiply
    return float(a[0] * later[0]), float((b * later).sum())


def last_value(df: DataFrame, group: str, order: list[str], a: Column, b: Column, start: float) -> DataFrame:
    """(group, value, n): where x -> a * x + b ends in each group, from start, and its number of rows; rows alike in all of order are interchangeable."""
    kind = dict(df.dtypes)[group]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = df.select(F.col(group).alias("group"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], a.cast("double").alias("a"), b.cast("double").alias("b"))
    keys = ["group", *[f"o{i}" for i in range(len(order))]]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], group_kind), pa.array([part] * len(out), pa.int32()), *[pa.array(c, k) for c, k in zip(columns[1:], (pa.float64(), pa.float64(), pa.int64()))]], ["group", "part", "a", "b", "n"])

        group_kind = None
        for batch in batches:
            groups = batch.column("group")
            group_kind = groups.type
            x, y = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            runs = groups.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.nonzero(np.diff(runs))[0] + 1).tolist(), len(runs)] if len(runs) else [0]
            for begin, end in zip(bounds, bounds[1:]):
                key = groups[begin].as_py()
                one, more = composed(x[begin:end], y[begin:end])
                if held is not None and held[0] == key:
                    held = (key, one * held[1], one * held[2] + more, held[3] + end - begin)
                    continue
                if held is not None:
                    out.append(held)
                held = (key, one, more, end - begin)
            if len(out) >= 10_000:
                yield told()
                out = []
        if held is not None:
            out.append(held)
            yield told()

    ranged = steps.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("group", "a", "b")
    pieces = ranged.mapInArrow(fold, f"group {kind}, part int, a double, b double, n bigint")
    # a piece a task at most
    whole = pieces.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "n"))).alias("s"))
    value = F.aggregate("s", F.lit(float(start)), lambda x, s: s["a"] * x + s["b"])
    return whole.select(F.col("group").alias(group), value.alias("value"), F.aggregate("s", F.lit(0).cast("bigint"), lambda n, s: n + s["n"]).alias("n"))
