"""Fusing the channels of a row: pooled channels side by side, a mixture of experts, a projection, and the hyperboloid.

Weights are given (they are trained elsewhere) and go to the tasks once; their size is that of the model. A batch is a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeworks.functions import vectors as V


@dataclass(frozen=True)
class Expert:
    """Two layers with a rectifier between them."""

    into: np.ndarray  # hidden x input
    into_bias: np.ndarray
    out: np.ndarray  # output x hidden
    out_bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.into.T + self.into_bias, 0.0) @ self.out.T + self.out_bias


@dataclass(frozen=True)
class Fusion:
    """The gate (experts x input), the experts, the projection (output x input), how many experts a row uses, and the longest tangent vector."""

    gate: np.ndarray
    gate_bias: np.ndarray
    experts: tuple[Expert, ...]
    projection: np.ndarray
    projection_bias: np.ndarray
    top_k: int = 2
    c: float = 1.0
    longest: float = 3.0

    def __post_init__(self) -> None:
        width = self.gate.shape[1]
        if len(self.experts) != len(self.gate) or not 1 <= self.top_k <= len(self.experts):
            raise ValueError("the gate must have a row for each expert, and top_k must lie between 1 and their number")
        if self.projection.shape[1] != width or any(e.into.shape[1] != width or len(e.out) != width for e in self.experts):
            raise ValueError("gate, experts and projection must have the width of all channels")

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(points on the hyperboloid, projected vectors, gate probabilities, experts used with the greatest first) of rows of pooled channels.

        Equally likely experts go by their number. The weights of those used are the softmax over them alone.
        """
        logits = x @ self.gate.T + self.gate_bias
        raised = np.exp(logits - logits.max(1, keepdims=True))
        chance = raised / raised.sum(1, keepdims=True)
        used = np.argsort(-logits, axis=1, kind="stable")[:, : self.top_k]
        top = np.take_along_axis(logits, used, 1)
        weight = np.exp(top - top.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        mixed = np.zeros_like(x)
        for e, expert in enumerate(self.experts):
            row, place = np.nonzero(used == e)
            if len(row):
                mixed[row] += weight[row, place][:, None] * expert(x[row])
        flat = mixed @ self.projection.T + self.projection_bias
        norm = np.linalg.norm(flat, axis=1, keepdims=True)
        held = flat * np.minimum(1.0, self.longest / np.maximum(norm, 1e-8))
        length = np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-8)
        angle = np.minimum(np.sqrt(self.c) * length, V.WIDEST)
        points = np.hstack([np.cosh(angle) / np.sqrt(self.c), held * np.sinh(angle) / (np.sqrt(self.c) * length)])
        return points, flat, chance, used


def pooled(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The masked mean of each channel's token vectors (<channel>: list of vectors, <channel>_mask), side by side in one column x."""
    return df.withColumn("x", F.concat(*[V.masked_mean(F.col(c), F.col(f"{c}_mask")) for c in channels]))


def fused(df: DataFrame, model: Fusion, keys: Sequence[str]) -> DataFrame:
    """Of rows with pooled channels x: the keys, embedding (on the hyperboloid), embedding_euc, gate_probs and experts, the numbers of those used.

    x must be as wide as the model. Other columns are left out; no rows give none.
    """
    rows = df.select(*keys, F.col("x").cast("array<double>").alias("x"))
    names = ["embedding", "embedding_euc", "gate_probs", "experts"]
    kinds = [T.ArrayType(T.DoubleType())] * 3 + [T.ArrayType(T.IntegerType())]
    schema = T.StructType([*[rows.schema[k] for k in keys], *[T.StructField(n, t) for n, t in zip(names, kinds)]])
    known = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = [_lists(m, np.int32 if n == "experts" else np.float64) for n, m in zip(names, known.value(x))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *out], [*keys, *names])

    return rows.mapInArrow(apply, schema)


def _lists(m: np.ndarray, kind: type) -> pa.ListArray:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m, dtype=kind).ravel()))
