"""Training triplets (anchor, positive, negative) from pair tables, with margins and a cap on unrelated negatives.

Input is a pair table with idx_i, idx_j, code_i, code_j, relation_id, distance.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.pairs import kept, pair_table
from cladeworks.sources.stages import stage_root, staged

UNRELATED = 99.0
# Margins of special cases and the weights of the two margins.
EXCLUDED_MARGIN, UNRELATED_RELATION, UNRELATED_DISTANCE = 0.1, 15.0, 10.0
EQUAL_DISTANCE, HALF_STEP = 0.3333, 0.6667
RELATION_SHARE, DISTANCE_SHARE = 0.3333, 0.6667
CAP = 100


def positives(pairs: DataFrame) -> DataFrame:
    """Pairs whose distance is not the table's greatest, as anchor and positive."""
    top = pairs.agg(F.max("distance").alias("top"))
    return (
        pairs.crossJoin(F.broadcast(top))  # one row
        .where("distance <> top")
        .select(
            F.col("idx_i").alias("anchor_idx"), F.col("idx_j").alias("positive_idx"), F.col("code_i").alias("anchor_code"),
            F.col("code_j").alias("positive_code"), F.col("relation_id").alias("positive_relation"), F.col("distance").alias("positive_distance"),
        )
        .distinct()
    )


def negatives(pairs: DataFrame) -> DataFrame:
    """All pairs, as anchor and negative."""
    return pairs.select(
        F.col("idx_j").alias("negative_idx"), F.col("code_i").alias("anchor_code"), F.col("code_j").alias("negative_code"),
        F.col("relation_id").alias("negative_relation"), F.col("distance").alias("negative_distance"),
    ).distinct()


def negative_candidates(pairs: DataFrame) -> DataFrame:
    """The negatives that a positive brings: later codes of its own pairs."""
    return pairs.select(F.col("code_i").alias("positive_code"), F.col("code_j").alias("negative_code")).distinct()


def margins(pr: Column, nr: Column, pd: Column, nd: Column) -> dict[str, Column]:
    """Relation, distance and combined margin; the distance rules look at the relation margin before its overrides."""
    rm0, dm0 = (nr - pr).cast("double"), nd - pd
    rm = F.when(nd == 0, EXCLUDED_MARGIN).when(nd == UNRELATED, UNRELATED_RELATION).otherwise(rm0)
    dm = (
        F.when(nd == 0, EXCLUDED_MARGIN)
        .when((rm0 > 0) & (dm0 == 0), EQUAL_DISTANCE)
        .when((rm0 > 0) & (dm0 == -0.5), HALF_STEP)
        .when(nd == UNRELATED, UNRELATED_DISTANCE)
        .otherwise(dm0)
    )
    return {"relation_margin": rm, "distance_margin": dm}


def with_margins(df: DataFrame) -> DataFrame:
    """Add flags and margins to rows with both relations and distances; rows without positive margins go."""
    pd, nd = F.col("positive_distance"), F.col("negative_distance")
    return (
        df.where("positive_distance > 0")
        .withColumns(
            {"unrelated": F.greatest(pd, nd) == UNRELATED, "excluded": F.least(pd, nd) == 0}
            | margins(F.col("positive_relation"), F.col("negative_relation"), pd, nd)
        )
        .where("relation_margin > 0 and distance_margin > 0")
        .withColumn("margin", 1 / (RELATION_SHARE * F.col("relation_margin") + DISTANCE_SHARE * F.col("distance_margin")))
    )


def triplets(pairs: DataFrame) -> DataFrame:
    """All triplets with positive margins: the negative is a pair of the positive and of the anchor."""
    joined = positives(pairs).join(negative_candidates(pairs), "positive_code").join(negatives(pairs), ["anchor_code", "negative_code"])
    return with_margins(joined).withColumns({f"{c}_level": F.length(f"{c}_code") for c in ("anchor", "positive", "negative")}).select(*COLUMNS)


COLUMNS = (
    "anchor_idx", "positive_idx", "negative_idx", "anchor_code", "positive_code", "negative_code", "anchor_level", "positive_level", "negative_level",
    "excluded", "unrelated", "relation_margin", "distance_margin", "margin", "positive_relation", "negative_relation", "positive_distance", "negative_distance",
)


class Layout:
    """Positives and negatives of a taxonomy's own pair table, as tables bucketed and sorted by anchor.

    A pair table that is made from the nodes has every pair that pairs.kept() keeps, so whether a negative is a pair of the positive is told from their two codes. That leaves one
    join, on the anchor, whose sides lie in the same buckets: triplets are made without an exchange, however many they are.
    """

    def __init__(self, nodes: DataFrame, excluded: DataFrame | None = None, buckets: int | None = None):
        spark = nodes.sparkSession
        pairs = staged(pair_table(nodes, excluded), "layout-pairs")
        buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        negative = negatives(pairs).join(F.broadcast(nodes.select(F.col("code").alias("anchor_code"), F.col("index").alias("anchor_idx"))), "anchor_code")  # a row a node
        self.positives = self._table(positives(pairs).where("positive_distance > 0"), buckets, "positives")
        self.negatives = self._table(negative.drop("anchor_code"), buckets, "negatives")

    @staticmethod
    def _table(df: DataFrame, buckets: int, name: str) -> DataFrame:
        spark, table = df.sparkSession, f"cladeworks_{name}_{uuid.uuid4().hex}"
        # dealt by the bucket's own hash, so each bucket is one sorted file
        df.repartition(buckets, "anchor_idx").write.bucketBy(buckets, "anchor_idx").sortBy("anchor_idx").option("path", f"{stage_root(spark)}/{table}").saveAsTable(table)
        return spark.table(table)

    def triplets(self) -> DataFrame:
        """What triplets() gives for the pair table."""
        level = lambda code: F.length(code)
        fits = kept(level("positive_code"), F.col("positive_code"), level("negative_code"), F.col("negative_code"))
        joined = self.positives.join(self.negatives.hint("merge"), "anchor_idx").where(fits)
        return with_margins(joined).withColumns({f"{c}_level": level(f"{c}_code") for c in ("anchor", "positive", "negative")}).select(*COLUMNS)


def cap_unrelated(df: DataFrame, order: Column, most: int = CAP) -> DataFrame:
    """Keep at most so many unrelated negatives per (anchor, positive), the first by order; all others stay."""
    nth = F.row_number().over(Window.partitionBy("anchor_idx", "positive_idx", "unrelated").orderBy(order, "negative_idx"))
    return df.withColumn("_nth", nth).where(~F.col("unrelated") | (F.col("_nth") <= most)).drop("_nth")


def seeded_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order that depends on the seed and the keys, not on the layout of the data."""
    return F.xxhash64(F.lit(seed), *keys)


def stats(df: DataFrame) -> DataFrame:
    """Triplets by positive and negative relation with their share in percent."""
    n = df.groupBy("positive_relation", "negative_relation").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def write_partitioned(df: DataFrame, path: str) -> None:
    """Hive-partitioned by anchor: a directory per anchor_idx."""
    df.withColumn("anchor", F.col("anchor_idx")).repartition("anchor").write.partitionBy("anchor").mode("overwrite").parquet(path)


def read_partitioned(spark, path: str, nodes: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Triplets of anchors of the given levels: only their directories are read."""
    df = spark.read.parquet(path)
    if levels is None:
        return df
    wanted = nodes.where(F.col("level").isin(levels)).select(F.col("index").alias("anchor"))
    return df.join(F.broadcast(wanted), "anchor", "left_semi")  # node ids of one taxonomy: prunes partitions
