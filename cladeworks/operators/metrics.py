"""Ranking, correlation and structure metrics over tables of distances.

A pair table here has id_i, id_j (both orders where ranks per anchor are meant), d (distance by embedding) and
t (distance in the tree). Rankings break ties by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.quantiles import exact
from cladeworks.operators.ranking import numbered

LEAST_TREE = 0.1  # pairs nearer than this in the tree don't count


def ranked(pairs: DataFrame, by: str = "d") -> DataFrame:
    """Add nth, the 1-based rank of id_j among the others of id_i."""
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("id_i").orderBy(by, "id_j")))


def precision_recall(ranks: DataFrame, relevant: Column, k: int) -> DataFrame:
    """Mean precision and recall at k over all anchors."""
    per = ranks.withColumn("_r", relevant.cast("int")).groupBy("id_i").agg(
        F.sum(F.when(F.col("nth") <= k, F.col("_r")).otherwise(0)).alias("hits"), F.sum("_r").alias("total"), F.least(F.count("*"), F.lit(k)).alias("k")
    )
    return per.agg(
        F.lit(k).alias("k"), F.avg(F.col("hits") / F.col("k")).alias("precision"), F.avg(F.col("hits") / F.greatest("total", F.lit(1))).alias("recall")
    )


def mean_average_precision(ranks: DataFrame, relevant: Column) -> DataFrame:
    """Mean over anchors of the average precision at relevant ranks."""
    before = Window.partitionBy("id_i").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    seen = ranks.withColumn("_r", relevant.cast("int")).withColumn("_p", F.sum("_r").over(before) / F.col("nth"))
    per = seen.groupBy("id_i").agg((F.sum(F.col("_p") * F.col("_r")) / F.greatest(F.sum("_r"), F.lit(1))).alias("ap"))
    return per.agg(F.avg("ap").alias("map"))


def discounted(value: Column, nth: Column, k: int) -> Column:
    return F.sum(F.when(nth <= k, value / F.log2(nth + 1)).otherwise(0.0))


def ndcg(ranks: DataFrame, relevance: Column, k: int) -> DataFrame:
    """NDCG at k of every anchor with graded relevance; 0 where nothing is relevant."""
    ideal = F.row_number().over(Window.partitionBy("id_i").orderBy(F.desc("_rel"), "id_j"))
    graded = ranks.withColumn("_rel", relevance).withColumn("_ideal", ideal)
    per = graded.groupBy("id_i").agg(discounted(F.col("_rel"), F.col("nth"), k).alias("dcg"), discounted(F.col("_rel"), F.col("_ideal"), k).alias("best"))
    return per.select("id_i", F.lit(k).alias("k"), F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def tree_relevance(t: Column, top: Column) -> Column:
    return (top - t + 1e-6) / (top + 1e-6)


def ndcg_ranking(pairs: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Mean NDCG by tree relevance for each k, and how many anchors have enough candidates for all of them."""
    per = Window.partitionBy("id_i")
    valid = pairs.where(F.col("t") >= LEAST_TREE).withColumns({"_n": F.count("*").over(per), "_top": F.max("t").over(per)}).where(F.col("_n") >= max(ks))
    ranks = ranked(valid).withColumn("rel", tree_relevance(F.col("t"), F.col("_top")))
    out = None
    for k in ks:
        one = ndcg(ranks, F.col("rel"), k).groupBy("k").agg(F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries"))
        out = one if out is None else out.unionByName(one)
    return out


def cophenetic(pairs: DataFrame, d: str = "d", t: str = "t") -> DataFrame:
    """Pearson correlation over pairs (each once) far enough apart in the tree; 0 with fewer than two."""
    n = F.count("*")
    kept = pairs.where(F.col(t) >= LEAST_TREE)
    return kept.agg(F.when(n < 2, 0.0).otherwise(F.coalesce(F.nanvl(F.corr(d, t), F.lit(0.0)), F.lit(0.0))).alias("correlation"), n.alias("n_pairs"))


def spearman(pairs: DataFrame) -> DataFrame:
    """Pearson correlation of ordinal ranks; ties go by (id_i, id_j)."""
    out = pairs.where(F.col("t") >= LEAST_TREE).select("id_i", "id_j", "d", "t")
    for value in ("d", "t"):
        out = numbered(out, [value, "id_i", "id_j"], f"rank_{value}")
    n = F.count("*")
    return out.agg(F.when(n < 2, 0.0).otherwise(F.coalesce(F.nanvl(F.corr("rank_d", "rank_t"), F.lit(0.0)), F.lit(0.0))).alias("correlation"), n.alias("n_pairs"))


def distortion(pairs: DataFrame) -> DataFrame:
    """Ratios of distances: mean, extremes, sample deviation and lower median."""
    ratio = F.col("d") / F.greatest("t", F.lit(1e-10))
    r = pairs.where(F.col("t") >= LEAST_TREE).select(ratio.alias("r"))
    median = F.nullif(F.lit(exact(r, "r", [0.5], lower=True)[None][0]), F.lit(float("nan")))
    return r.agg(F.avg("r").alias("mean"), F.max("r").alias("max"), F.min("r").alias("min"), F.stddev_samp("r").alias("std"), median.alias("median"))


def collapse(norms: DataFrame, pairs: DataFrame, variance: DataFrame) -> DataFrame:
    """Spread statistics and flags: norm and distance variation and mean variance against their limits.

    norms has n, pairs d, variance v (the variance of each dimension).
    """
    return collapse_of(norms, pairs.agg(F.avg("d").alias("distance_mean"), F.stddev_samp("d").alias("distance_std")), variance)


def collapse_of(norms: DataFrame, spread: DataFrame, variance: DataFrame) -> DataFrame:
    """collapse() from the spread of distances, one row (distance_mean, distance_std)."""
    a = norms.agg(F.avg("n").alias("norm_mean"), F.stddev_samp("n").alias("norm_std"))
    c = variance.agg(F.avg("v").alias("variance_mean"))
    one = a.crossJoin(spread).crossJoin(c)  # one row each
    cv = one.withColumns(
        {"norm_cv": F.col("norm_std") / F.greatest("norm_mean", F.lit(1e-8)), "distance_cv": F.col("distance_std") / F.greatest("distance_mean", F.lit(1e-8))}
    )
    return cv.withColumns(
        {"variance_collapse": F.col("variance_mean") < 0.001, "norm_collapse": F.col("norm_cv") < 0.05, "distance_collapse": F.col("distance_cv") < 0.05}
    )


def radius_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level separation and monotonicity of radii: nodes (id, level, radius), edges (parent, child)."""
    quartiles = nodes.sparkSession.createDataFrame([(level, *q) for level, q in exact(nodes, "radius", [0.75, 0.25], by="level").items()], f"level {dict(nodes.dtypes)['level']}, p75 double, p25 double")
    levels = nodes.groupBy("level").agg(F.avg("radius").alias("mean")).join(F.broadcast(quartiles), "level")  # a handful of levels
    order = Window.orderBy("level")  # a handful of levels
    gaps = levels.select((F.lead("mean").over(order) - F.col("mean") - F.greatest(F.col("p75") - F.lead("p25").over(order), F.lit(0.0))).alias("gap")).where("gap is not null")
    a = nodes.select(F.col("id").alias("parent"), F.col("radius").alias("rp"))
    b = nodes.select(F.col("id").alias("child"), F.col("radius").alias("rc"))
    steps = edges.join(a, "parent").join(b, "child")
    return gaps.agg(F.avg("gap").alias("separation")).crossJoin(
        steps.agg(F.avg((F.col("rc") > F.col("rp")).cast("double")).alias("monotonicity"), F.count("*").alias("n_edges"))
    )


def hierarchy_retrieval(ranks: DataFrame, edges: DataFrame, parent_k: int = 1, child_k: int = 5) -> DataFrame:
    """Parents found, mean share of children found, and how often the nearest neighbour is a sibling."""
    up = edges.select(F.col("child").alias("id_i"), F.col("parent").alias("id_j"))
    parents = up.join(ranks, ["id_i", "id_j"]).agg(F.avg((F.col("nth") <= parent_k).cast("double")).alias("parent_retrieval"))
    down = edges.select(F.col("parent").alias("id_i"), F.col("child").alias("id_j")).join(ranks, ["id_i", "id_j"])
    children = down.groupBy("id_i").agg(F.avg((F.col("nth") <= child_k).cast("double")).alias("s")).agg(F.avg("s").alias("child_retrieval"))
    pairs = siblings(edges).join(ranks, ["id_i", "id_j"])
    confused = pairs.groupBy("id_i").agg(F.max((F.col("nth") == 1).cast("double")).alias("c")).agg(F.avg("c").alias("sibling_confusion"))
    return parents.crossJoin(children).crossJoin(confused)


def taxonomy_reconstruction(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of nodes whose parent is among the k nearest nodes one level up."""
    level_i = nodes.select(F.col("id").alias("id_i"), F.col("level").alias("level_i"))
    level_j = nodes.select(F.col("id").alias("id_j"), F.col("level").alias("level_j"))
    above = pairs.join(level_i, "id_i").join(level_j, "id_j").where("level_j = level_i - 1")
    return parents_found(ranked(above), edges, ks)


def parents_found(ranks: DataFrame, edges: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """taxonomy_reconstruction from the ranks of nodes one level up, of which those of parents are enough."""
    found = ranks.join(edges.select(F.col("child").alias("id_i"), F.col("parent").alias("id_j")), ["id_i", "id_j"])
    return found.agg(F.count("*").alias("evaluated"), *[F.avg((F.col("nth") <= k).cast("double")).alias(f"top_{k}") for k in ks])


def siblings(edges: DataFrame) -> DataFrame:
    """(id_i, id_j) of all children of one parent, both ways."""
    both = edges.alias("x").join(edges.alias("y"), (F.col("x.parent") == F.col("y.parent")) & (F.col("x.child") != F.col("y.child")))
    return both.select(F.col("x.child").alias("id_i"), F.col("y.child").alias("id_j"))


def family(edges: DataFrame) -> DataFrame:
    """(id_i, id_j) whose places hierarchy_retrieval looks at: parents, children and siblings."""
    up = edges.select(F.col("child").alias("id_i"), F.col("parent").alias("id_j"))
    return up.unionByName(edges.select(F.col("parent").alias("id_i"), F.col("child").alias("id_j"))).unionByName(siblings(edges))


def sibling_similarity(ranks: DataFrame, edges: DataFrame, ks: tuple[int, ...] = (5, 10), sizes: DataFrame | None = None) -> DataFrame:
    """Mean share of siblings among the k nearest, and mean rank of the first sibling. Ranks of siblings are enough if sizes has (id_i, n: others)."""
    pairs = siblings(edges).join(ranks, ["id_i", "id_j"])
    sizes = ranks.groupBy("id_i").agg(F.count("*").alias("n")) if sizes is None else sizes
    per = pairs.groupBy("id_i").agg(F.min("nth").alias("first"), *[F.count_if(F.col("nth") <= k).alias(f"h{k}") for k in ks]).join(sizes, "id_i")
    shares = [F.avg(F.col(f"h{k}") / F.greatest(F.least("n", F.lit(k)), F.lit(1))).alias(f"precision_{k}") for k in ks]
    return per.agg(F.count("*").alias("evaluated"), *shares, F.avg("first").alias("mean_first_rank"))


def validation(df: DataFrame, k: int) -> DataFrame:
    """Of rows (anchor, dp, dn: array of negative distances): means, spread, accuracies and mean positive rank."""
    nearer = F.size(F.filter("dn", lambda x: x <= F.col("dp")))
    closest = F.slice(F.array_sort("dn"), 1, k)
    rows = df.select(
        "dp", "dn", (nearer == 0).cast("double").alias("all"), F.forall(closest, lambda x: F.col("dp") < x).cast("double").alias("top"),
        F.size(F.filter("dn", lambda x: x < F.col("dp"))).alias("rank"),
    )
    flat = rows.select(F.explode(F.concat(F.array("dp"), "dn")).alias("d"))
    spread = flat.agg((F.stddev_samp("d") / F.greatest(F.avg("d"), F.lit(1e-8))).alias("distance_spread"))
    negative = rows.select(F.explode("dn").alias("d")).agg(F.avg("d").alias("avg_negative_dist"))
    main = rows.agg(
        F.avg("dp").alias("avg_positive_dist"), F.avg("all").alias("relation_accuracy"), F.avg("top").alias("top_k_accuracy"), F.avg("rank").alias("mean_positive_rank")
    )
    return main.crossJoin(negative).crossJoin(spread)  # one row each


def verify_change(before: DataFrame, after: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row per metric (metric, value in both): change, limit and whether the loss stays within it; pass is all."""
    joined = before.withColumnRenamed("value", "old").join(after.withColumnRenamed("value", "new"), "metric")
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("metric"))
    rows = joined.select("metric", "old", "new", (F.col("new") - F.col("old")).alias("change"), limit.alias("limit"))
    return rows.withColumn("ok", F.col("change") >= -F.col("limit")).withColumn("passed", F.every("ok").over(Window.partitionBy()))
