"""A slot for models: batches of rows go through a function inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Loader = Callable[[], Callable[[list[str]], np.ndarray]]


def embedded(df: DataFrame, text: str, load: Loader, batch: int = 256) -> DataFrame:
    """(index, level, code, x): vectors of the texts by the function that load() returns, once per task.

    Texts go through it in batches of bounded size; null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = model([x or "" for x in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([[float(y) for y in v] for v in vectors], pa.list_(pa.float64()))], ["index", "level", "code", "x"]
                )

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select("index", "level", "code", text).mapInArrow(run, f"index {kinds['index']}, level {kinds['level']}, code {kinds['code']}, x array<double>")
