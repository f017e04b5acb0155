"""K-means on the hyperboloid: seeding, assignment, approximate Frechet means, and label agreement."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeworks.functions import vectors as V
from cladeworks.operators.pairwise import distances
from cladeworks.sources.stages import staged, unstaged

BATCH = 1 << 21  # distances that are computed together


def centre_frame(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Add cluster and d2, the nearest centre (ties: the lower) and the squared distance; points have x and any other columns.

    Centres are the k rows that the caller asked for, so they go to the tasks as one array.
    """
    rows = sorted((r.cluster, list(r.centre)) for r in centres.collect())
    return assigned(points, np.array([c for _, c in rows]), np.array([k for k, _ in rows]))


def assigned(points: DataFrame, centres: np.ndarray, names: np.ndarray | None = None) -> DataFrame:
    """assign() for centres of an array."""
    names = np.arange(len(centres)) if names is None else names
    kept = points.drop("cluster", "d2")
    columns = kept.columns

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best, at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
            step = max(1, BATCH // len(centres))
            for begin in range(0, len(x), step):
                d = distances(x[begin : begin + step], centres, "lorentz", 1.0)
                at[begin : begin + step] = d.argmin(1)
                best[begin : begin + step] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[at], pa.int32()), pa.array(best * best)], [*columns, "cluster", "d2"])

    schema = T.StructType([*kept.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())])
    return kept.mapInArrow(nearest, schema)


def uniform(seed: int) -> Column:
    """A draw above 0 and below 1 per id, the same whoever asks."""
    return (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 31)) + 0.5) / float(1 << 31)


def seeded_centres(points: DataFrame, k: int, seed: int, rounds: int = 5, oversampling: float = 2.0) -> np.ndarray:
    """k-means||: in each round every point is drawn by its share of the squared distances to the candidates so far, oversampling * k of them on the whole.

    Points are then counted by their nearest candidate, and k-means++ over the weighted candidates (at most about rounds * oversampling * k) leaves k. So
    there is a pass a round and one more, whatever k is; points have id and x.
    """
    first = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("x").limit(1).collect()
    if not first:
        raise ValueError("no points to seed centres from")
    candidates = np.array([list(first[0].x)])
    for step in range(1, rounds + 1):
        near = staged(assigned(points.select("id", "x"), candidates).where("d2 > 0").select("id", "x", "d2"), "seeding")
        total = near.agg(F.sum("d2")).first()[0]
        if not total:
            break
        drawn = near.where(uniform(seed + step) < F.lit(oversampling * k / total) * F.col("d2")).orderBy("id").select("x").collect()  # oversampling * k on the whole
        unstaged(near)
        if drawn:
            candidates = np.vstack([candidates, np.array([list(r.x) for r in drawn])])
    counts = dict(assigned(points.select("id", "x"), candidates).groupBy("cluster").agg(F.count("*").alias("n")).collect())
    weight = np.array([counts.get(i, 0) for i in range(len(candidates))], dtype=float)
    return _reduced(candidates, weight, k, seed)


def _reduced(candidates: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of weighted candidates by k-means++; the best of a few draws each time. With fewer candidates the first stands in."""
    rng = np.random.default_rng(seed)
    squared = lambda c: distances(candidates, c, "lorentz", 1.0) ** 2
    chosen = [int(rng.choice(len(candidates), p=weight / weight.sum()))]
    gap = squared(candidates[chosen])[:, 0]
    while len(chosen) < k:
        mass = weight * gap
        if not mass.sum():
            chosen.append(chosen[0])
            continue
        tried = rng.choice(len(candidates), size=2 + int(np.log(k)), p=mass / mass.sum())
        left = np.minimum(gap[:, None], squared(candidates[tried]))
        best = int((weight[:, None] * left).sum(0).argmin())
        chosen.append(int(tried[best]))
        gap = left[:, best]
    return candidates[chosen]


def means(assigned: DataFrame, width: int | None = None) -> DataFrame:
    """Approximate Frechet mean of each cluster: the mean of tangent vectors at the origin, mapped back. width: entries of x, if known."""
    width = width or assigned.agg(F.max(F.size("x"))).first()[0] or 1
    tangent = assigned.select("cluster", V.space(V.log_zero(F.col("x"))).alias("v"))
    dims = tangent.groupBy("cluster").agg(V.summed(F.col("v"), width - 1).alias("s"), F.count("*").alias("n"))
    return dims.select("cluster", V.exp_zero(V.scaled(F.col("s"), 1 / F.col("n"))).alias("centre"))


def fit(points: DataFrame, k: int, seed: int = 42, rounds: int = 10, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centres and inertia; an emptied cluster keeps its centre. Only k centres come to the driver."""
    points = staged(points.select("id", "x"), "points")
    centres = seeded_centres(points, k, seed)
    for _ in range(rounds):
        new = centres.copy()
        for row in means(assigned(points, centres), centres.shape[1]).collect():  # k rows
            new[row.cluster] = row.centre
        product = 2 * new[:, 0] * centres[:, 0] - (new * centres).sum(1)
        shift = np.arccosh(np.maximum(product, 1.0)).max()
        centres = new
        if shift < tolerance:
            break
    inertia = assigned(points, centres).agg(F.sum("d2")).first()[0]
    unstaged(points)
    return centres, float(inertia or 0.0)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    joint = cells.join(rows, a).join(cols, b).crossJoin(total)
    sums = joint.agg(
        F.sum(pairs(F.col("n"))).alias("both"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi")
    )
    entropy = lambda d, n: d.crossJoin(total).agg(F.sum(pairs(F.col(n))).alias(f"p{n}"), F.sum(-F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t"))).alias(f"h{n}"))
    one = sums.crossJoin(entropy(rows, "na")).crossJoin(entropy(cols, "nb")).crossJoin(total)  # one row each
    chance = F.col("pna") * F.col("pnb") / pairs(F.col("t"))
    most = (F.col("pna") + F.col("pnb")) / 2
    return one.select(
        F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / (most - chance)).alias("ari"),
        F.when(F.col("hna") + F.col("hnb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hna") + F.col("hnb"))).alias("nmi"),
    )
