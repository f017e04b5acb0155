"""Losses in closed form over tables of distances and vectors."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators.recurrence import last_value
from cladeworks.sources.stages import staged, unstaged

LOWEST = -3.4028234663852886e38  # least single-precision number: what a masked similarity is set to


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def contrastive(rows: DataFrame, temperature: float, margin: float = 0.0) -> DataFrame:
    """Decoupled contrastive loss of rows (dp, dn array, masked array of booleans): positives are not in the sum."""
    similar = F.zip_with("dn", "masked", lambda d, m: F.when(m, F.lit(LOWEST)).otherwise(-F.greatest(d - margin, F.lit(0.0)) / temperature))
    return rows.agg(F.avg(F.col("dp") / temperature + log_sum_exp(similar)).alias("loss"), F.count("*").alias("n"))


def hierarchy_preservation(pairs: DataFrame, weight: float, least: float = 0.1) -> DataFrame:
    """Weighted mean squared difference of relative distances; 0 with fewer than two pairs."""
    kept = pairs.where(F.col("t") >= least)
    means = kept.agg(F.avg("d").alias("md"), F.avg("t").alias("mt"))
    gap = F.col("d") / F.col("md") - F.col("t") / F.col("mt")
    return kept.crossJoin(F.broadcast(means)).agg(F.when(F.count("*") < 2, 0.0).otherwise(weight * F.avg(gap * gap)).alias("loss"))  # one row


def rank_order(pairs: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean hinge over (anchor, j, k) with j nearer than k in the tree but not by the margin in space; only active ones count.

    Triples are never formed: for each tree distance of an anchor, its pairs at that distance and all farther ones are sorted by
    distance in space once, and running counts and sums give each pair what it meets.
    """
    levels = pairs.agg(F.array_sort(F.collect_set("t")).alias("_levels"))  # one row, as many entries as there are tree distances
    near = pairs.select("id_i", F.col("t").alias("level"), (F.col("d") + margin).alias("key"), F.lit(0).alias("far"))
    spread = pairs.crossJoin(F.broadcast(levels)).select("id_i", F.explode(F.filter("_levels", lambda x: x < F.col("t"))).alias("level"), F.col("d").alias("key"), F.lit(1).alias("far"))
    before = Window.partitionBy("id_i", "level").orderBy("key", "far").rowsBetween(Window.unboundedPreceding, -1)
    met = near.unionByName(spread).withColumns({"n": F.sum("far").over(before), "s": F.sum(F.col("far") * F.col("key")).over(before)}).where("far = 0 and n > 0")
    total, active = F.sum(F.col("n") * F.col("key") - F.col("s")), F.sum("n")
    return met.agg((F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(active, F.lit(0)), F.lit(1))).alias("loss"), active.alias("n_active"))


def lambda_rank(pairs: DataFrame, k: int = 10, sigma: float = 1.0) -> DataFrame:
    """Pairwise logistic loss weighted by the change of NDCG at k when two entries swap places; one number per anchor.

    pairs has (anchor, id_j, d: distance, rel: relevance); entries are ranked by distance, ties by id. Only swaps with one of
    the first k places change the NDCG, so those are joined with an anchor's entries, and no two lists are compared whole.
    """
    per = Window.partitionBy("anchor")
    discount = lambda nth: F.when(F.col(nth) <= k, 1 / F.log2(F.col(nth) + 1)).otherwise(0.0)
    ranked = pairs.select("anchor", "id_j", "d", "rel").withColumns({"nth": F.row_number().over(per.orderBy("d", "id_j")), "best": F.row_number().over(per.orderBy(F.desc("rel")))})
    ideal = ranked.where(F.col("best") <= k).groupBy("anchor").agg(F.sum(F.col("rel") * discount("best")).alias("ideal"))
    # pairs of unlike relevance: all pairs less those inside one
    sizes = ranked.groupBy("anchor", "rel").agg(F.count("*").alias("n")).groupBy("anchor").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("unlike"))
    entries = ranked.select("anchor", "d", "rel", "nth", discount("nth").alias("discount"))
    top = entries.where(F.col("nth") <= k).select("anchor", *[F.col(c).alias(f"top_{c}") for c in ("d", "rel", "nth", "discount")])
    both = entries.join(top, "anchor").where("rel <> top_rel and nth > top_nth")  # once each: the earlier place is the top one
    change = F.abs((F.col("rel") - F.col("top_rel")) * (F.col("discount") - F.col("top_discount")))
    ahead = F.when(F.col("rel") > F.col("top_rel"), F.col("top_d") - F.col("d")).otherwise(F.col("d") - F.col("top_d"))  # how much nearer the better one is
    cost = F.log1p(F.exp(-F.abs(sigma * ahead))) + F.greatest(-sigma * ahead, F.lit(0.0))
    sums = both.groupBy("anchor").agg(F.sum(change * cost).alias("total"))
    joined = ideal.join(sizes, "anchor").join(sums, "anchor", "left")
    loss = F.coalesce("total", F.lit(0.0)) / F.greatest("ideal", F.lit(1e-10)) / F.greatest("unlike", F.lit(1.0))
    return joined.select("anchor", loss.alias("loss"))


def weighted_total(terms: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One row: the sum of (name, loss) rows by their weights; a term without a weight counts once, a null loss is 0."""
    named = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w))]) if weights else F.lit(None).cast("map<string,double>")
    return terms.agg(F.coalesce(F.sum(F.coalesce(F.try_element_at(named, F.col("name")), F.lit(1.0)) * F.coalesce("loss", F.lit(0.0))), F.lit(0.0)).alias("total"))


def uncertainty_total(terms: DataFrame) -> DataFrame:
    """One row: losses (name, loss, s) weighted by half of exp(-s), s the logarithm of a term's variance, which costs half of itself."""
    return terms.agg(F.sum(0.5 * F.exp(-F.col("s")) * F.col("loss") + 0.5 * F.col("s")).alias("total"))


def attention_layers(vecs: DataFrame, edges: DataFrame, layers: int, most: float = 3.0) -> DataFrame:
    """(id, x) after some rounds of messages: vecs (id, x) on the hyperboloid, edges (src, dst, score).

    In a round every tangent vector takes what comes along its edges, weighted by the softmax of the scores per target; its norm is
    held at most and it goes back to the hyperboloid. Nodes without edges keep theirs. A message is summed by the tasks that make it, entry by entry in one
    row a target, before it is shuffled, and each round is a staged table, so the plan of a round is the same however many there are.
    """
    rows = vecs.select("id", "x")
    width = (rows.agg(F.max(F.size("x"))).first()[0] or 1) - 1
    tops = edges.groupBy("dst").agg(F.max("score").alias("_top"))
    weighed = staged(edges.join(tops, "dst").select("src", "dst", F.exp(F.col("score") - F.col("_top")).alias("weight")), "layer-edges")
    table = None
    for _ in range(layers):
        tangent = rows.select("id", V.space(V.log_zero(F.col("x"))).alias("t"))
        sent = weighed.join(tangent.withColumnRenamed("id", "src"), "src")
        got = sent.groupBy(F.col("dst").alias("id")).agg(V.summed(F.col("t"), width, F.col("weight")).alias("m"), F.sum("weight").alias("w"))
        moved = tangent.join(got, "id", "left").withColumn("t", F.when(F.col("m").isNull(), F.col("t")).otherwise(V.added(F.col("t"), V.scaled(F.col("m"), 1 / F.col("w")))))
        before, table = table, staged(moved.select("id", V.exp_zero(V.capped(F.col("t"), most)).alias("x")), "layer")
        if before is not None:
            unstaged(before)
        rows = table
    return rows


def triplet(dp: Column, dn: Column, margin: Column | float, temperature: float = 1.0) -> Column:
    m = margin if isinstance(margin, Column) else F.lit(margin)
    return F.greatest((dp - dn + m) / temperature, F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def smooth_l1(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap < 1, 0.5 * gap * gap).otherwise(gap - 0.5)


def level_radius(x: Column, level: Column) -> Column:
    """Smooth L1 between the norm of the space part and half the depth."""
    return smooth_l1(F.sqrt(F.greatest(x[0] * x[0] - 1, F.lit(1e-8))), (level - 2) / 2.0)


def radius_penalty(x: Column, weight: float, most: float = 10.0, c: float = 1.0) -> Column:
    """Weighted mean of the squared excess of the norm over a limit."""
    over = F.greatest(F.sqrt(F.greatest(x[0] * x[0] - 1 / c, F.lit(0.0)) + 1e-8) - most, F.lit(0.0))
    return weight * F.avg(over * over)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def graph_margin(base: float, alpha: float, d: Column, relation: Column, scale: float = 1.0) -> Column:
    """Margin that grows for near and closely related pairs."""
    return clamped(base + alpha * (1 - F.tanh(d / 4)) + 0.2 * (1 - F.tanh(relation / 6)), 0.4, 2.0) * scale


def confidence_margin(base: float, confidence: Column, difficulty: Column) -> Column:
    return clamped(base + 0.5 * (1 - confidence) + 0.2 * (1 - difficulty), 0.5, 3.0)


def graph_margins(base: float, alpha: float, d: np.ndarray, relation: float, scale: float = 1.0) -> np.ndarray:
    """graph_margin of arrays."""
    return np.clip(base + alpha * (1 - np.tanh(d / 4)) + 0.2 * (1 - np.tanh(relation / 6)), 0.4, 2.0) * scale


def confidence_margins(base: float, confidence: np.ndarray, difficulty: float) -> np.ndarray:
    """confidence_margin of arrays."""
    return np.clip(base + 0.5 * (1 - confidence) + 0.2 * (1 - difficulty), 0.5, 3.0)


def confidence(observations: DataFrame, rate: float = 0.1, start: float = 0.5) -> DataFrame:
    """Per node, the running mean of 1 - clip(d / 10) over its observations (node, ord, d) in order, and their number.

    A step is (1 - rate) * x + rate * seen, so a node with very many observations is shared by tasks.
    """
    seen = rate * (1 - clamped(F.col("d") / 10, 0.0, 1.0))
    last = last_value(observations, "node", ["ord", "d"], F.lit(1 - rate), seen, start)
    return last.select("node", F.col("value").alias("confidence"), F.col("n").cast("int").alias("n"))


def distillation(student: Column, teacher: Column, temperature: float = 2.0) -> Column:
    """Mean squared difference at a temperature."""
    return F.avg(F.pow((student - teacher) / temperature, F.lit(2.0)))


def pushed(negative: Column, mean: Column, by: float = 0.1) -> Column:
    """A vector moved by a share of the way towards the mean of negatives."""
    return V.added(V.scaled(negative, F.lit(1 - by)), V.scaled(mean, F.lit(by)))


def entropy(p: Column) -> Column:
    return -F.aggregate(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(1e-10)))), F.lit(0.0), lambda s, x: s + x)


def phase_loss(phase: Column, base: Column, adversarial: Column, distilled: Column) -> Column:
    """The loss of a curriculum phase: plain, adaptive, with adversarial part, or half distillation."""
    return F.when(phase <= 2, base).when(phase == 3, base + 0.1 * adversarial).otherwise(0.5 * base + 0.5 * distilled)


def mean_by(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def softmax_by(df: DataFrame, group: str, score: Column) -> DataFrame:
    """Add attention: softmax of the score inside each group."""
    per = Window.partitionBy(group)
    named = df.withColumn("_s", score)
    raised = named.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(per)))
    return raised.withColumn("attention", F.col("_e") / F.sum("_e").over(per)).drop("_s", "_e")
