"""The curvature's schedule and points that are kept on the hyperboloid."""

import math

from pyspark.sql import functions as F

from cladeworks.functions import manifold
from cladeworks.functions import vectors as V


def test_curvature_by_phase():
    c = manifold.Curvature()
    assert c.c == 2.0 and not c.learns and c.moved(3.0) == c
    second = c.at(2)
    assert second.c == 1.0 and second.learns and second.moved(0.5).c == 1.5
    assert second.moved(50.0).c == 10.0 and second.moved(-50.0).c == 0.1 and second.moved(50.0).moved(-48.0).c == 3.0
    assert manifold.Curvature.restored(second.moved(0.25).saved()) == second.moved(0.25) and second.moved(0.25).at(1).c == 2.0


def test_points_are_kept_and_counted_in_one_pass(spark):
    m = manifold.Manifold(manifold.Curvature(4.0, 3))
    rows = [(i, [0.1 * i, -0.2]) for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id int, t array<double>").withColumn("x", m.to_points(F.col("t")))
    moved = df.withColumn("x", F.when(F.col("id") % 4 == 1, F.transform("x", lambda e: e + 0.3)).otherwise(F.col("x")))
    kept, seen = m.kept(moved, "x")
    points = {r.id: r.x for r in kept.collect()}
    told = m.diagnostics(seen)
    assert (told["points"], told["violations"], told["projected"], told["curvature"], told["phase"]) == (10, 3, 3, 4.0, 3) and told["worst"] > 0.1
    assert points[10] is None and all(abs(-p[0] ** 2 + p[1] ** 2 + p[2] ** 2 + 0.25) < 1e-9 for i, p in points.items() if i < 10)
    bare, seen = manifold.Manifold(m.curvature, project=False).kept(moved, "x", "bare")
    assert bare.where(m.off(F.col("x")) > 1e-4).count() == 3 and seen.get["projected"] == 0 and seen.get["violations"] == 3


def test_operations_use_the_curvature(spark):
    m = manifold.Manifold(manifold.Curvature())
    df = spark.createDataFrame([([0.3, 0.4],)], "t array<double>").withColumn("x", m.to_points(F.col("t")))
    r = df.select(m.distance(F.col("x"), m.to_points(F.array(F.lit(0.0), F.lit(0.0)))).alias("d"), V.norm(V.space(m.to_tangent(F.col("x")))).alias("n")).first()
    assert abs(r.d - V_distance(0.5)) < 1e-4 and r.n > 0


def V_distance(length, c=2.0):  # noqa: N802
    """From the origin: the root of c times the angle, with time coordinates cosh / root c."""
    return math.sqrt(c) * math.acosh(max(1.0, math.cosh(math.sqrt(c) * length) / c))
