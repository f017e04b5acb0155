"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.common import cut, dropped

SALTS = 8  # tasks that share the edges of one node


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) of any orderable type: one row (node, root) per node, root its component's least node.

    Self-loops and nulls are left out; nodes without an edge are not in the result. Every round is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the upper end of each edge moves to the least neighbour of its lower end; a hub's edges are salted
        salted = least.select(F.col("a").alias("b"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        ends = now.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        large = ends.join(salted, ["b", "salt"]).select("a", F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, cut(moved.unionByName(lower.withColumnRenamed("m", "b")).distinct(), "edges")
        dropped(last)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Tells edge tables apart: their number and a sum of hashes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)
