"""Recurrences split between tasks, layers of messages, and seeding in few passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators import cluster, losses, pairwise, recurrence


@pytest.mark.parametrize("hot", [0, 3000])
def test_recurrence_equals_the_fold(spark, hot):
    rng = np.random.default_rng(6)
    rows = [(None if n == 3 else n, int(o), float(a), float(b)) for n in range(8) for o, a, b in zip(rng.permutation(40), rng.uniform(0.5, 1.1, 40), rng.normal(size=40))]
    rows += [(99, i, 0.999, float(b)) for i, b in enumerate(rng.normal(size=hot))]
    df = spark.createDataFrame(rows, "node long, ord long, a double, b double").repartition(5)
    got = {r.node: (r.value, r.n) for r in recurrence.last_value(df, "node", ["ord"], F.col("a"), F.col("b"), 0.5).collect()}
    for node in {r[0] for r in rows}:
        x, mine = 0.5, sorted(r[1:] for r in rows if r[0] == node)
        for _, a, b in mine:
            x = a * x + b
        assert got[node][1] == len(mine) and abs(got[node][0] - x) < 1e-9 * max(1, abs(x))
    assert len(got) == 8 + bool(hot)


def test_a_node_with_all_rows_is_shared_by_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("node"), F.col("id").alias("ord"), (F.col("id") % 13).cast("double").alias("d"))
    ranged = df.repartitionByRange(4, "node", "ord").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 4 and max(r["count"] for r in ranged) < 10_000
    got = losses.confidence(df).first()
    x = 0.5
    for i in range(20_000):
        x = 0.9 * x + 0.1 * (1 - min(i % 13 / 10, 1))
    assert abs(got.confidence - x) < 1e-9 and got.n == 20_000


def test_ten_layers_have_small_plans(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(0, 0.3, (30, 4))
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "id bigint, t array<double>").select("id", V.exp_zero(F.col("t")).alias("x"))
    edges = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 30, 80), [7] * 40 + rng.integers(0, 28, 40).tolist(), rng.normal(size=80))]  # half go to one target
    out = losses.attention_layers(vecs, spark.createDataFrame(edges, "src bigint, dst bigint, score double"), 10)
    assert len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()) < 5
    for _ in range(10):
        new = t.copy()
        for target in range(30):
            mine = [(a, s) for a, b, s in edges if b == target]
            if mine:
                w = np.exp([s for _, s in mine])
                new[target] = t[target] + (w / w.sum()) @ t[[a for a, _ in mine]]
        norm = np.maximum(np.linalg.norm(new, axis=1), 1e-8)
        t = new * np.minimum(1, 3.0 / norm)[:, None]
    got = {r.id: r.x for r in out.collect()}
    for i in range(30):
        n = np.linalg.norm(t[i])
        assert np.allclose(got[i], np.append(np.cosh(n), np.sinh(n) / n * t[i]), rtol=1e-3)


def plus_plus(x, k, rng):
    centres = [x[rng.integers(len(x))]]
    gap = pairwise.distances(x, np.array(centres), "lorentz", 1.0)[:, 0] ** 2
    while len(centres) < k:
        centres.append(x[rng.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, pairwise.distances(x, np.array(centres[-1:]), "lorentz", 1.0)[:, 0] ** 2)
    return gap.sum()


def test_many_centres_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(200, 3))[rng.integers(0, 200, 4000)] * 1.5 + rng.normal(size=(4000, 3)) * 0.02
    x = np.hstack([np.sqrt(1 + (v * v).sum(1))[:, None], v])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, x array<double>").repartition(4)
    passes = []
    real = cluster.assigned
    monkeypatch.setattr(cluster, "assigned", lambda *a: passes.append(1) or real(*a))
    centres = cluster.seeded_centres(df, 200, 5)
    assert len(passes) == 6 and centres.shape == (200, 4)
    got = (pairwise.distances(x, centres, "lorentz", 1.0) ** 2).min(1).sum()
    assert got < 1.1 * min(plus_plus(x, 200, np.random.default_rng(s)) for s in range(3))
    assert (cluster.seeded_centres(df, 200, 5) == centres).all()


def test_assignment_keeps_columns_and_ties_go_low(spark):
    x = [[1.0, 0.0], [float(np.cosh(1.0)), float(np.sinh(1.0))], [float(np.cosh(1.0)), -float(np.sinh(1.0))]]
    df = spark.createDataFrame([("a", x[0], 5), ("b", x[1], 6)], "name string, x array<double>, cluster int")
    centres = spark.createDataFrame([(4, x[1]), (2, x[2])], "cluster int, centre array<double>")
    got = {r.name: (r.cluster, round(r.d2, 9)) for r in cluster.assign(df, centres).collect()}
    assert got == {"a": (2, 1.0), "b": (4, 0.0)}
    assert cluster.assign(df.limit(0), centres).count() == 0
    with pytest.raises(ValueError, match="no points"):
        cluster.seeded_centres(df.limit(0).withColumn("id", F.lit(1)), 2, 1)
