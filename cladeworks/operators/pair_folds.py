"""Sums and counts over all pairs of vectors that tiles make: a row a tile, tree distance and bin leaves a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.operators.pair_stats import TILE_PAIRS, Tree
from cladeworks.operators.pairwise import each_block, pair_tiles


def by_tree(
    vecs: DataFrame, metric: str, tree: Tree, sums: Callable[[np.ndarray, float], list[np.ndarray]], width: int, vector: str = "x", label: str = "label", least: float = 1 + 1e-5, c: float = 1.0
) -> DataFrame:
    """(t, n, s): for each tree distance the number of pairs, each once, and the sums of width numbers that sums makes of their distances and the tree distance."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[float, list] = {}
        for block in each_block(batches, metric, False, least, c):
            if block is None:
                if held:
                    t, rows = list(held), list(held.values())
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64()))], ["t", "n", "s"])
                held = {}
                continue
            a, b, value, counts = block
            own, other = a.label(), b.label()
            for one in np.unique(own):  # a row of the tree for each label of the left
                r = np.nonzero(np.isnan(own) if np.isnan(one) else own == one)[0]
                far = np.broadcast_to(np.asarray(tree(np.array([[one]]), other[None, :]), dtype=float), (1, len(other)))[0]
                for t in np.unique(far):
                    at = np.ix_(r, np.nonzero(far == t)[0])
                    d = value[at][counts[at]]
                    if len(d):
                        n, total = held.setdefault(float(t), [0, np.zeros(width)])
                        held[float(t)] = [n + len(d), total + [float(x.sum()) for x in sums(d, float(t))]]

    parts = pair_tiles(vecs, vector, False, label, TILE_PAIRS).mapInArrow(fold, "t double, n bigint, s array<double>")
    return parts.groupBy("t").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))


def histogram(vecs: DataFrame, metric: str, bin_of: Callable[[np.ndarray], np.ndarray], vector: str = "v", least: float = 1 + 1e-5, c: float = 1.0) -> DataFrame:
    """(bin, n): how many pairs, each once, have their distance or similarity in each bin, an integer."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for block in each_block(batches, metric, False, least, c):
            if block is None:
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64())], ["bin", "n"])
                held = {}
                continue
            bins = bin_of(block[2][block[3]]).astype(np.int64)
            if len(bins):
                low = int(bins.min())
                n = np.bincount(bins - low) if int(bins.max()) - low < 1 << 20 else None
                found = zip(*np.unique(bins, return_counts=True)) if n is None else ((low + i, n[i]) for i in np.nonzero(n)[0])
                for at, some in found:
                    held[int(at)] = held.get(int(at), 0) + int(some)

    return pair_tiles(vecs, vector, False, None, TILE_PAIRS).mapInArrow(fold, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
