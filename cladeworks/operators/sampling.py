"""Sampling of negatives and positives: weights as columns, one primitive to draw by them.

Draws are exponential races: in each group the n rows with the least -ln(u)/weight are a weighted
sample without replacement. u is a digest of seed and keys, so a draw doesn't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.pairwise import nearest
from cladeworks.operators.quantiles import exact
from cladeworks.operators.ranking import numbered

MISSING_DISTANCE = 12.0  # of the sampler
SCHEDULER_MISSING = 10.0  # of the scheduler's helper
EXCLUSION_WEIGHT = 100.0
NEAR_LIMIT, NEAR_SHARE, FAR_SHARE = 4.0, 0.65, 0.35


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1): the first 48 bits of the MD5 of seed and keys, comma-joined, so any other engine can draw it too."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)


def race(weight: Column, u: Column) -> Column:
    """Arrival time; rows of weight 0 come last."""
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def weighted_top(df: DataFrame, group: list[str], weight: str, n: int | Column, seed: int, keys: list[str]) -> DataFrame:
    """A weighted sample of n rows at most from each group; groups whose weights are all 0 are drawn uniformly."""
    inside = Window.partitionBy(*group)
    total = F.sum(weight).over(inside)
    w = F.when(total > 0, F.col(weight)).otherwise(F.lit(1.0))
    timed = df.withColumn("_time", race(w, uniform(seed, *keys)))
    nth = F.row_number().over(inside.orderBy("_time", *keys))
    return timed.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_time", "_nth")


def filters(wanted: Mapping[str, object]) -> Column:
    """Conjunction of config entries: lists are IN, booleans equality, numbers and nulls ignored; else every anchor."""
    parts = []
    for name, value in wanted.items():
        if isinstance(value, bool):
            parts.append(F.col(name) == value)
        elif isinstance(value, (list, tuple)):
            parts.append(F.col(name).isin(list(value)))
    return reduce(and_, parts) if parts else F.col("anchor_idx") >= 0


# --- weights

def phase1_weight(distance: Column, excluded: Column, alpha: float = 1.5, missing: float = MISSING_DISTANCE) -> Column:
    """Explicit exclusions weigh most, siblings (distance 2) nothing, others by inverse power of distance."""
    d = F.coalesce(distance, F.lit(missing))
    return F.when(excluded, EXCLUSION_WEIGHT).when(d == 2.0, 0.0).when(d > 0, F.pow(d, F.lit(-alpha))).otherwise(0.0)


def scheduler_weight(
    df: DataFrame, group: list[str], distance: str, excluded: str, alpha: float, sibling_limit: float = 2.0, missing: float = SCHEDULER_MISSING
) -> DataFrame:
    """Add weight: as phase1_weight, siblings up to a limit masked, normalised in the group, uniform if all are 0."""
    d = F.coalesce(F.col(distance), F.lit(missing))
    raw = F.when(F.col(excluded), EXCLUSION_WEIGHT).when(d.between(2.0, sibling_limit), 0.0).when(d > 0, F.pow(d, F.lit(-alpha))).otherwise(0.0)
    inside = Window.partitionBy(*group)
    named = df.withColumn("_raw", raw)
    total, n = F.sum("_raw").over(inside), F.count("*").over(inside)
    return named.withColumn("weight", F.when(total > 0, F.col("_raw") / total).otherwise(1 / n)).drop("_raw")


def sans_weight(
    df: DataFrame, group: list[str], distance: Column, limit: float = NEAR_LIMIT, near: float = NEAR_SHARE, far: float = FAR_SHARE, missing: float = MISSING_DISTANCE
) -> DataFrame:
    """Add near and weight: near and far candidates of a group share fixed masses, equal inside each.

    If one side is empty the other one gets all; if both masses are 0 all weigh the same.
    """
    inside = Window.partitionBy(*group)
    named = df.withColumn("near", F.coalesce(distance, F.lit(missing)) <= limit)
    n_near, n = F.sum(F.col("near").cast("int")).over(inside), F.count("*").over(inside)
    n_far = n - n_near
    mass = F.when(n_near > 0, near).otherwise(0.0) + F.when(n_far > 0, far).otherwise(0.0)
    own = F.when(F.col("near"), F.lit(near) / n_near).otherwise(F.lit(far) / F.greatest(n_far, F.lit(1)))
    return named.withColumn("weight", F.when(mass > 0, own / mass).otherwise(1 / n))


def sans_metadata(weighted: DataFrame, sampled: DataFrame, group: list[str]) -> DataFrame:
    """Candidates, sampled rows and effective mass of both sides, per group."""
    near, far = F.col("near"), ~F.col("near")
    of = weighted.groupBy(*group).agg(
        F.count_if(near).alias("candidates_near"), F.count_if(far).alias("candidates_far"),
        F.sum(F.when(near, F.col("weight")).otherwise(0.0)).alias("effective_near_weight"),
        F.sum(F.when(far, F.col("weight")).otherwise(0.0)).alias("effective_far_weight"),
    )
    got = sampled.groupBy(*group).agg(F.count_if(near).alias("sampled_near"), F.count_if(far).alias("sampled_far"))
    return of.join(got, group, "left").fillna(0, ["sampled_near", "sampled_far"])


def metadata_totals(metadata: DataFrame) -> DataFrame:
    """Sums of counts and means of weights over a batch."""
    counts = ("candidates_near", "candidates_far", "sampled_near", "sampled_far")
    return metadata.agg(
        *[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in ("effective_near_weight", "effective_far_weight")]
    )


def margin_weight(df: DataFrame) -> DataFrame:
    """Graph sampler: excluded rows get 1 on both margins, then weight is the inverse of their mean."""
    raised = {m: F.when(F.col("excluded"), F.col(m) + 1).otherwise(F.col(m)) for m in ("relation_margin", "distance_margin")}
    return df.withColumns(raised).withColumn("sample_wgt", 2 / (F.col("relation_margin") + F.col("distance_margin")))


def sample_positives(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Rows of n random positives at most per anchor, with all their negatives."""
    pairs = df.select("anchor_idx", "positive_idx").distinct()
    nth = F.row_number().over(Window.partitionBy("anchor_idx").orderBy(uniform(seed, "anchor_idx", "positive_idx"), "positive_idx"))
    kept = pairs.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")
    return df.join(kept, ["anchor_idx", "positive_idx"], "left_semi")


def graph_sample(df: DataFrame, n_positives: int, n_negatives: int, seed: int) -> DataFrame:
    """The graph sampler end to end: weights, positives per anchor, weighted negatives per pair."""
    kept = sample_positives(margin_weight(df), n_positives, seed)
    return weighted_top(kept, ["anchor_idx", "positive_idx"], "sample_wgt", n_negatives, seed, ["anchor_idx", "positive_idx", "negative_idx"])


def text_sample(df: DataFrame, strategy: str, n: int, seed: int, alpha: float = 1.5) -> DataFrame:
    """The text sampler end to end: 'sans', 'phase1' or 'uniform' negatives for each (anchor, positive)."""
    group, keys = ["anchor_idx", "positive_idx"], ["anchor_idx", "positive_idx", "negative_idx"]
    if strategy == "sans":
        weighted = sans_weight(df, group, F.col("negative_distance"))
    elif strategy == "phase1":
        weighted = df.withColumn("weight", phase1_weight(F.col("negative_distance"), F.col("excluded"), alpha))
    elif strategy == "uniform":
        weighted = df.withColumn("weight", F.lit(1.0))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return weighted_top(weighted, group, "weight", n, seed, keys).withColumn("explicit_exclusion", F.col("excluded") & F.lit(strategy == "phase1"))


# --- shapes for training

def nested(df: DataFrame) -> DataFrame:
    """One row per (anchor, positive) with its negatives as an array of structs, by margin and index."""
    negative = F.struct("negative_idx", "negative_code", "relation_margin", "distance_margin")
    lists = df.groupBy("anchor_idx", "anchor_code", "positive_idx", "positive_code").agg(F.array_sort(F.collect_list(negative)).alias("negatives"))
    return lists.withColumn("n_negatives", F.size("negatives"))


def multi_level(nested_rows: DataFrame, ancestors: DataFrame) -> DataFrame:
    """One row per positive to train on: six-digit anchors with every ancestor that is a positive, others with their first.

    All share the negatives of the anchor's first positive.
    """
    first = nested_rows.groupBy("anchor_idx", "anchor_code").agg(
        F.min_by(F.struct("positive_idx", "positive_code", "negatives"), "positive_idx").alias("first")
    )
    up = (
        first.where(F.length("anchor_code") == 6)
        .join(ancestors.select(F.col("code").alias("anchor_code"), F.col("ancestor").alias("positive_code"), "steps"), "anchor_code")
        .select("anchor_code", "positive_code", "steps", F.size("first.negatives").alias("n_negatives"))
    )
    rest = first.where(F.length("anchor_code") < 6).select("anchor_code", "first.positive_code", F.lit(0).alias("steps"), F.size("first.negatives").alias("n_negatives"))
    return up.unionByName(rest)


def padded(negatives: Column, n: int) -> Column:
    """The first n entries; shorter lists are filled up with their last one."""
    fill = F.array_repeat(F.element_at(negatives, -1), F.greatest(F.lit(n) - F.size(negatives), F.lit(0)))
    return F.slice(F.when(F.size(negatives) > 0, F.concat(negatives, fill)).otherwise(negatives), 1, n)


def curriculum_filter(negatives: Column, max_relation: float, max_distance: float) -> Column:
    """Negatives within both limits, filled up with the last of them; all if none is."""
    within = F.filter(negatives, lambda x: (x["relation"] <= max_relation) & (x["distance"] <= max_distance))
    fill = F.array_repeat(F.element_at(within, -1), F.size(negatives) - F.size(within))
    return F.when(F.size(within) == 0, negatives).otherwise(F.concat(within, fill))


def ordered_split(df: DataFrame, order: list[str], train: float = 0.95) -> DataFrame:
    """Add split: the first share of rows is 'train', the rest 'validation', one row each at least."""
    n = df.count()
    cut = min(max(int(n * train), 1), max(n - 1, 1))
    return numbered(df, order, "_nth").withColumn("split", F.when(F.col("_nth") < cut, "train").otherwise("validation")).drop("_nth")


def shard(row_number: Column, workers: int) -> Column:
    """The worker that gets a row: every workers-th."""
    return row_number % workers


# --- strategies of the graph curriculum

def hub_candidates(scores: DataFrame, top: float = 0.2) -> DataFrame:
    """Nodes whose composite score reaches the (1 - top) quantile."""
    return scores.where(F.col("composite") >= exact(scores, "composite", [1 - top])[None][0])


def difficulty_weight(margin: Column) -> Column:
    """The margin, 0.1 where there is none, 1e-8 at least."""
    return F.greatest(F.coalesce(margin, F.lit(0.1)), F.lit(1e-8))


def mixed_negatives(ranked: DataFrame, pool: DataFrame, n: int, hard_share: float, seed: int) -> DataFrame:
    """n negatives per anchor: hard ones by rank up to their share, the rest uniformly from the pool.

    ranked has (anchor, negative, nth), pool (anchor, negative). Where hard ones are short, uniform ones fill up.
    """
    hard = ranked.where(F.col("nth") <= int(n * hard_share)).select("anchor", "negative", F.lit(0).alias("tier"), F.col("nth").cast("double").alias("key"))
    rest = pool.join(hard.select("anchor", "negative"), ["anchor", "negative"], "left_anti").select(
        "anchor", "negative", F.lit(1).alias("tier"), uniform(seed, "anchor", "negative").alias("key")
    )
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy("tier", "key", "negative"))
    return hard.unionByName(rest).withColumn("nth", nth).where(F.col("nth") <= n).select("anchor", "negative", (F.col("tier") == 0).alias("hard"), "nth")


def hard_cache(vectors: DataFrame, k: int = 50, positives: str = "label") -> DataFrame:
    """The k nearest negatives of each vector (id, v); vectors with the same value of the column positives are none."""
    found = nearest(vectors, k, "euclidean", apart=positives)
    return found.select(F.col("id_i").alias("anchor"), F.col("id_j").alias("negative"), "value", "nth")


def cache_is_stale(epoch: int, built: int | None, every: int = 3) -> bool:
    """Whether a hard-negative cache has to be built again."""
    return built is None or epoch - built >= every


# Share of hard negatives by sampler.
HARD_SHARES = {"hub_uniform": 0.0, "difficulty_weighted": 0.0, "hard_negative": 0.5, "blended": 0.3}


def hard_count(sampler: str, n: int) -> int:
    """How many hard negatives a sampler draws of n at most."""
    return int(n * HARD_SHARES[sampler])


def curriculum_negatives(sampler: str, ranked: DataFrame, pool: DataFrame, n: int, seed: int) -> DataFrame:
    """Negatives by the phase's sampler: hard ones up to its share, uniform ones for the rest."""
    if sampler not in HARD_SHARES:
        raise ValueError(f"unknown sampler {sampler!r}")
    return mixed_negatives(ranked, pool, n, HARD_SHARES[sampler], seed)


def consecutive_groups(df: DataFrame, run: str, order: str, key: str) -> DataFrame:
    """Add group: it grows whenever the key differs from that of the row before, inside each run."""
    w = Window.partitionBy(run).orderBy(order)
    changed = (~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int")
    return df.withColumn("_new", changed).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def scattered_sample(df: DataFrame, key: str, n: int, step: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """n rows in a scattered order of an integer key: a repeatable evaluation sample."""
    return df.orderBy((F.col(key).cast("long") * step) % modulus, key).limit(n)
