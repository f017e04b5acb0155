"""Graph analytics over edge tables (src, dst): degree, PageRank, k-core, relation statistics."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.quantiles import exact
from cladeworks.sources.stages import staged, unstaged

BLOCK_EDGES = 1 << 19  # edges, both ways, whose nodes a task settles together


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def edge_index(relations: DataFrame, allowed: list[str], base: float = 1.0) -> DataFrame:
    """Typed, weighted edges both ways plus a self-loop per node.

    Types number the allowed relations by name; weight falls with the relation id, 0.05 at least; loops weigh 1 and have the next type.
    """
    kept = relations.where(F.col("relation").isin(allowed))
    kind = (F.dense_rank().over(Window.orderBy("relation")) - 1).cast("int")
    kinds = kept.select("relation").distinct().withColumn("type", kind)  # a handful of names
    weight = F.greatest(F.lit(0.05), F.lit(base) / (1 + 0.2 * F.greatest(F.lit(0), F.col("relation_id") - 1)))
    one_way = kept.join(F.broadcast(kinds), "relation").select(F.col("idx_i").alias("src"), F.col("idx_j").alias("dst"), "type", weight.alias("weight"))
    back = one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
    nodes = one_way.select("src").union(one_way.select("dst")).distinct()
    loops = nodes.crossJoin(kinds.agg(F.count("*").cast("int").alias("type"))).select("src", F.col("src").alias("dst"), "type", F.lit(1.0).alias("weight"))
    return one_way.unionByName(back).unionByName(loops)


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-degree over mirrored edges, by the number of other nodes; nodes has id."""
    n = nodes.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("others"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    return nodes.join(out, "id", "left").crossJoin(F.broadcast(n)).select("id", (F.coalesce("out", F.lit(0)) / F.col("others")).alias("degree"))


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, stage_every: int = 5) -> DataFrame:
    """(id, rank): power iteration that lets the mass of dangling nodes go, scaled to sum 1 at the end.

    It stops once the summed change falls below the tolerance (None: never). Ranks are staged every few rounds.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = staged(edges.join(out, "src").select("src", "dst", (1 / F.col("out")).alias("share")), "links")
    ranks = table = staged(nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank")), "pagerank")
    for step in range(1, rounds + 1):
        sent = links.join(ranks, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(sent, F.col("id") == F.col("to"), "left").select("id", F.col("rank").alias("old"), (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tolerance is not None or step % stage_every == 0:
            before, table = table, staged(new, "pagerank")
            unstaged(before)  # nothing reads the rounds before any more
            new = table
        ranks = new.select("id", "rank")
        if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))


def _settled(rows: pa.Table) -> pa.Table:
    """(to, h): the greatest numbers of a block's nodes that bear out each other, given those of nodes elsewhere (rows with a value instead of dst).

    Nodes and edges that lead out go in the order of the number up to which they last, each taking one from what is left of its neighbours.
    """
    inner = rows.column("value").is_null().to_numpy()
    src = rows.column("src").to_numpy()
    ids, at = np.unique(src, return_inverse=True)
    own, to = at[inner], rows.column("dst").drop_null().to_numpy()
    slot = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    there = ids[slot] == to  # a node without an edge of its own has the number 0
    own, slot = own[there], slot[there]
    left, value = at[~inner], rows.column("value").drop_null().to_numpy()
    order = np.argsort(slot, kind="stable")
    first, into = np.searchsorted(slot[order], np.arange(len(ids) + 1)).tolist(), own[order].tolist()
    count = (np.bincount(own, minlength=len(ids)) + np.bincount(left, minlength=len(ids))).tolist()
    span = 2 * len(ids)  # keys: number, then node, or node behind an edge that leads out
    heap = [n * span + v for v, n in enumerate(count)] + (value * span + len(ids) + left).tolist()
    heapq.heapify(heap)
    core, level = [-1] * len(ids), 0
    while heap:
        key, which = divmod(heapq.heappop(heap), span)
        if which >= len(ids):
            level, less = max(level, key), (which - len(ids),)
        elif core[which] >= 0 or key != count[which]:
            continue  # lowered since
        else:
            level = max(level, key)
            core[which], less = level, into[first[which] : first[which + 1]]
        for v in less:
            if core[v] < 0 and count[v] > level:
                count[v] -= 1
                heapq.heappush(heap, count[v] * span + v)
    return pa.table({"to": pa.array(ids, pa.int64()), "h": pa.array(core, pa.int64())})


def kcore(edges: DataFrame, nodes: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(id, core): core numbers of the mirrored graph as the fixed point of neighbours' h-indices; ids are whole numbers.

    Nodes are cut by id into blocks of so many edges. A round settles every block, given the numbers of its neighbours in others, so what falls step by step inside of
    a block takes one round, and a chain of links as many rounds as it has blocks. Numbers start from degrees and only fall, so they end at the core numbers without peeling
    one by one. A node with more edges than a block gets its h-index by counts each round.
    """
    ids = nodes.select("id")
    both = edges.where("src <> dst").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct()
    for end in ("src", "dst"):
        both = both.join(ids.withColumnRenamed("id", end), end, "left_semi")
    both = staged(both, "kcore-edges")
    degrees = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("core"))
    now = table = staged(ids.join(degrees, "id", "left").select("id", F.coalesce("core", F.lit(0).cast("long")).alias("core")), "kcore")
    hubs = now.where(F.col("core") > block_edges).select("id")
    heavy = None if hubs.isEmpty() else staged(both.join(hubs.withColumnRenamed("id", "src"), "src", "left_semi"), "kcore-hubs")
    light = both if heavy is None else both.join(hubs.withColumnRenamed("id", "src"), "src", "left_anti")
    wanted = math.ceil(light.count() / block_edges)
    bounds = light.approxQuantile("src", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []  # a number a block
    block = lambda c: F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]), lambda x: x < F.col(c))) if bounds else F.lit(0)
    placed = light.select(block("src").alias("block"), block("dst").alias("other"), "src", "dst")
    outside = F.col("block") != F.col("other")
    if heavy is not None:
        placed = placed.join(hubs.select(F.col("id").alias("dst"), F.lit(True).alias("hub")), "dst", "left")
        outside |= F.col("hub").isNotNull()
    placed = staged(placed.select("block", "src", "dst", outside.alias("outside")), "kcore-blocks")
    inner, outer = placed.where("not outside"), placed.where("outside")
    while True:
        known = outer.join(now, F.col("dst") == F.col("id")).select("block", "src", F.lit(None).cast("bigint").alias("dst"), F.col("core").alias("value"))
        rows = inner.select("block", "src", "dst", F.lit(None).cast("bigint").alias("value")).unionByName(known)
        h = rows.groupBy("block").applyInArrow(_settled, "to bigint, h bigint")
        if heavy is not None:
            seen = heavy.join(now, F.col("dst") == F.col("id")).groupBy("src", "core").agg(F.count("*").alias("n"))
            atleast = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("core")))
            h = h.unionByName(seen.withColumn("h", F.least("core", atleast)).groupBy(F.col("src").alias("to")).agg(F.max("h").alias("h")))
        new = staged(now.join(h, F.col("id") == F.col("to"), "left").select("id", F.col("core").alias("old"), F.coalesce("h", F.lit(0).cast("long")).alias("core")), "kcore")
        unstaged(table)
        now, table = new.select("id", "core"), new
        if new.where("core <> old").isEmpty():
            return now


def node_scores(edges: DataFrame, nodes: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """Degree, PageRank, core number and their composite (0.4, 0.4, 0.2 of each scaled to 0..1); nodes has id, level."""
    both = staged(mirrored(edges), "edges")
    ids = nodes.select("id")
    table = nodes.join(degree_centrality(both, ids), "id").join(pagerank(both, ids, rounds=rounds, tolerance=tolerance), "id").join(kcore(both, ids), "id")
    ends = table.agg(*[f(c).alias(f"{p}_{c}") for c in ("degree", "rank", "core") for f, p in ((F.min, "lo"), (F.max, "hi"))])

    def scaled(c):
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        return F.when(span > 1e-8, (F.col(c) - F.col(f"lo_{c}")) / span).otherwise(0.0)

    composite = 0.4 * scaled("degree") + 0.4 * scaled("rank") + 0.2 * scaled("core")
    return table.crossJoin(F.broadcast(ends)).select("id", "level", "degree", F.col("rank").alias("pagerank"), F.col("core").alias("kcore"), composite.alias("composite"))


def relation_cardinality(relations: DataFrame, limit: float = 1.5) -> DataFrame:
    """Per relation: mean distinct tails per head and heads per tail, the class these give, a difficulty tier, edges."""
    keys = ["relation", "relation_id"]
    # each edge once; after that both sides are plain counts, which tasks sum before they shuffle
    relations = staged(relations.groupBy(*keys, "idx_i", "idx_j").agg(F.count("*").alias("times")), "distinct-edges")
    tails = relations.groupBy(*keys, "idx_i").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.avg("n").alias("tails_per_head"))
    heads = relations.groupBy(*keys, "idx_j").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.avg("n").alias("heads_per_tail"))
    edges = relations.groupBy(*keys).agg(F.sum("times").alias("num_edges"))
    many_heads, many_tails = F.col("heads_per_tail") > limit, F.col("tails_per_head") > limit
    kind = F.concat(F.when(many_heads, "N").otherwise("1"), F.lit("-"), F.when(many_tails, "N").otherwise("1"))
    tier = F.when(F.col("relation_id") <= 1, "easy").when(F.col("relation_id") <= 4, "medium").otherwise("hard")
    return tails.join(heads, keys).join(edges, keys).withColumns({"cardinality": kind, "difficulty_tier": tier})


def difficulty_thresholds(pairs: DataFrame, triplets: DataFrame) -> DataFrame:
    """One row: distance and margin limits of the four phases over all rows, fixed relation limits, statistics."""
    def of(df, column, name, shares):
        limits = exact(df, column, shares)[None]
        return df.agg(
            F.array(*[F.nullif(F.lit(x), F.lit(float("nan"))) for x in limits]).alias(f"{name}_p"), F.min(column).alias(f"{name}_min"), F.max(column).alias(f"{name}_max"),
            F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std"),
        )

    d, m = of(pairs, "distance", "distance", (0.2, 0.6, 0.9)), of(triplets, "margin", "margin", (0.8, 0.4, 0.1))
    return d.crossJoin(m).select(  # one row each
        *[F.col("distance_p")[i].alias(f"phase{i + 1}_max_distance") for i in range(3)], F.col("distance_max").alias("phase4_max_distance"),
        *[F.col("margin_p")[i].alias(f"phase{i + 1}_min_margin") for i in range(3)], F.lit(0.0).alias("phase4_min_margin"),
        *[F.lit(n).alias(f"phase{i + 1}_max_relation") for i, n in enumerate((1, 4, 10, 99))],
        "distance_min", "distance_mean", "distance_std", "margin_min", "margin_max", "margin_mean", "margin_std",
    )
