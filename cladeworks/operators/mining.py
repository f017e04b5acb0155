"""Hard-negative mining, router-guided mining, gates and false negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators.pairwise import nearest

EPSILON = 1e-8


def hard_negatives(anchors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates nearest to each anchor on the hyperboloid (column x), self left out."""
    return nearest(anchors, k, "lorentz", others=candidates, vector="x", least=1.0)


def safe_product(product: Column, margin: float = 1e-5) -> tuple[Column, Column]:
    """The Lorentz product held at -1 - margin at most, and whether it was below -1 by itself."""
    return F.least(product, F.lit(-1 - margin)), product <= -1


def lorentz_norm(x: Column) -> Column:
    return F.sqrt(F.greatest(x[0] * x[0] - V.norm_squared(V.space(x)), F.lit(EPSILON)))


def smoothed(p: Column) -> Column:
    """Probabilities with a floor, summing to one again."""
    raised = F.transform(p, lambda x: x + EPSILON)
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(smoothed(p), smoothed(q), lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda s, x: s + x)


def confusion(p: Column, q: Column, metric: str = "kl") -> Column:
    """How alike two gate vectors are: minus their divergence, or their cosine."""
    if metric == "kl":
        return -kl(p, q)
    if metric == "cosine":
        return V.cosine(p, q)
    raise ValueError(f"unknown metric {metric!r}")


def router_negatives(candidates: DataFrame, k: int, metric: str = "kl") -> DataFrame:
    """Of rows (anchor, negative, gate_a, gate_n): the k negatives per anchor whose gates are most alike."""
    scored = candidates.withColumn("score", confusion(F.col("gate_a"), F.col("gate_n"), metric))
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "negative"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).select("anchor", "negative", "score", "nth")


def router_nearest(gated: DataFrame, k: int, metric: str = "kl") -> DataFrame:
    """Of vectors (id, g: gate): the k others per anchor whose gates are most alike, out of all of them."""
    if metric not in ("kl", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if metric == "kl":
        found, score = nearest(gated, k, "divergence", vector="g"), -F.col("value")
    else:
        found, score = nearest(gated, k, "cosine_similarity", vector="g", largest=True), F.col("value")
    return found.select(F.col("id_i").alias("anchor"), F.col("id_j").alias("negative"), score.alias("score"), "nth")


def router_mix(router: DataFrame, hard: DataFrame, k: int, share: float = 0.5) -> DataFrame:
    """The first router negatives up to their share of k, then hard ones; both (anchor, negative, nth)."""
    n = int(k * share)
    a = router.where(F.col("nth") <= n).select("anchor", "negative", F.lit("router").alias("origin"))
    b = hard.where(F.col("nth") <= k - n).select("anchor", "negative", F.lit("hard").alias("origin"))
    return a.unionByName(b)


def false_negatives(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add false_negative: both sides have a pseudo-label (id, label) and it is the same."""
    a = labels.select(F.col("id").alias("anchor"), F.col("label").alias("label_a"))
    b = labels.select(F.col("id").alias("negative"), F.col("label").alias("label_n"))
    joined = pairs.join(a, "anchor", "left").join(b, "negative", "left")
    return joined.withColumn("false_negative", F.coalesce(F.col("label_a") == F.col("label_n"), F.lit(False)))


def false_negative_loss(marked: DataFrame, strategy: str) -> DataFrame:
    """What false negatives add: 'eliminate' masks them, 'attract' pulls them (1 - cosine), 'hybrid' does both."""
    if strategy not in ("eliminate", "attract", "hybrid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    wrong = F.col("false_negative")
    kept = F.count_if(~wrong) if strategy != "attract" else F.count("*")
    pull = F.avg(F.when(wrong, 1 - F.col("cosine"))) if strategy != "eliminate" else F.lit(None).cast("double")
    return marked.agg(kept.alias("n_negatives"), F.count_if(wrong).alias("n_false"), F.coalesce(pull, F.lit(0.0)).alias("attraction"))


def pseudo_labels(assigned: DataFrame) -> DataFrame:
    """The last label (by ord) of each code."""
    return assigned.groupBy("code").agg(F.max_by("label", "ord").alias("label"))


def gates(logits: Column, k: int) -> Column:
    """The k largest logits (ties: the lower expert) with their softmax over those, as (expert, weight)."""
    marked = F.transform(logits, lambda x, i: F.struct((-x).alias("key"), i.alias("expert")))
    top = F.slice(F.array_sort(marked), 1, k)
    weight = V.softmax(F.transform(top, lambda t: -t["key"]))
    return F.zip_with(top, weight, lambda t, w: F.struct(t["expert"].alias("expert"), w.alias("weight")))


def load_balance(rows: DataFrame, n_experts: int, k: int) -> DataFrame:
    """E times the sum over experts of the share of rows that use one and its mean probability; rows have logits."""
    named = rows.select(V.softmax(F.col("logits")).alias("p"), gates(F.col("logits"), k).alias("top"))
    n = named.agg(F.count("*").alias("rows"))
    used = named.select(F.explode("top").alias("t")).groupBy(F.col("t.expert").alias("expert")).agg(F.count("*").alias("uses"))
    mean = named.select(F.posexplode("p").alias("expert", "p")).groupBy("expert").agg(F.avg("p").alias("mean_p"))
    per = mean.join(used, "expert", "left").crossJoin(n).select("expert", (F.coalesce("uses", F.lit(0)) / F.col("rows")).alias("f"), "mean_p")
    return per.agg((n_experts * F.sum(F.col("f") * F.col("mean_p"))).alias("load_balance"), F.max("f").alias("top_share"))


def nearest_softmax(pairs: DataFrame, share: float, temperature: float) -> DataFrame:
    """Negatives (anchor, negative, d) weighted by softmax(-d/T) over the nearest share of each anchor's, 0 elsewhere."""
    per = Window.partitionBy("anchor")
    nth, n = F.row_number().over(per.orderBy("d", "negative")), F.count("*").over(per)
    placed = pairs.withColumns({"nth": nth, "_n": n})
    kept = F.col("nth") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    raised = F.when(kept, F.exp(-(F.col("d") - F.min("d").over(per)) / temperature)).otherwise(0.0)
    return placed.withColumn("_w", raised).withColumn("weight", F.col("_w") / F.sum("_w").over(per)).drop("_w", "_n")
