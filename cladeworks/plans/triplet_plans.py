"""Queries of groups C (triplets) and D (sampling), over the small taxonomy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeworks.operators import sampling as S
from cladeworks.operators import taxonomy as T
from cladeworks.operators import triplets as R
from cladeworks.operators.pairs import pair_table
from cladeworks.plans.binding import CUSTOMER_TAX, PAIRS_EXCLUDED, SUPPLIER_TAX, customer_nodes, exclusions, supplier_nodes
from cladeworks.sources.stages import stage_root, staged

ALPHA = 1.5
KEYS = ("anchor_idx", "positive_idx", "negative_idx")
#: An order that SQL can compute too.
SCATTERED = "(anchor_idx * 7919 + positive_idx * 104729 + negative_idx * 1299709) % 1000003"


def _pairs(spark, sf):
    nodes = supplier_nodes(spark, sf)
    return staged(pair_table(nodes, exclusions(nodes)), "pairs")


def _triplets(spark, sf):
    nodes = supplier_nodes(spark, sf)
    return R.Layout(nodes, exclusions(nodes)).triplets()


def _order():
    return F.expr(SCATTERED.replace("anchor_idx", "cast(anchor_idx as bigint)"))


def positive_pairs(spark, sf):
    return R.positives(_pairs(spark, sf)).select("anchor_idx", "positive_idx", "anchor_code", "positive_code", "positive_distance")


def negative_pairs(spark, sf):
    return R.negatives(_pairs(spark, sf)).select("negative_idx", "anchor_code", "negative_code", "negative_relation", "negative_distance")


def _digest(df):
    """Triplets by anchor: counts and sums that pin every column."""
    return df.groupBy("anchor_idx", "anchor_level").agg(
        F.count("*").alias("n"), F.count_if("excluded").alias("n_excluded"), F.count_if("unrelated").alias("n_unrelated"),
        F.round(F.sum("relation_margin"), 4).alias("relation_margin"), F.round(F.sum("distance_margin"), 4).alias("distance_margin"),
        F.round(F.sum("margin"), 4).alias("margin"), F.sum(_order()).alias("checksum"),
    )


def triplet_margins(spark, sf):
    return _digest(_triplets(spark, sf))


def triplet_stats(spark, sf):
    return R.stats(_triplets(spark, sf)).select("positive_relation", "negative_relation", "n", F.round("pct", 6).alias("pct"))


def triplet_stats_large(spark, sf):
    """The same over the large taxonomy, whose triplets are made and counted where their anchors lie."""
    nodes = customer_nodes(spark, sf)
    counts = R.stats(R.Layout(nodes, exclusions(nodes)).triplets())
    return counts.select("positive_relation", "negative_relation", "n", F.round("pct", 6).alias("pct"))


def triplets_capped(spark, sf):
    return _digest(R.cap_unrelated(_triplets(spark, sf), _order(), 20))


def triplets_partition_scan(spark, sf):
    """Written by anchor, read back for anchors of the upper levels only."""
    path = f"{stage_root(spark)}/triplets-{uuid.uuid4().hex}"
    R.write_partitioned(_triplets(spark, sf), path)
    return _digest(R.read_partitioned(spark, path, supplier_nodes(spark, sf), [2, 3]))


def filtered_candidates(spark, sf):
    wanted = {"anchor_level": [3, 4], "positive_level": [6], "excluded": False, "n_positives": 5}
    kept = _triplets(spark, sf).where(S.filters(wanted))
    return kept.groupBy("anchor_code", "positive_code").agg(F.count("*").alias("n"), F.max("negative_distance").alias("farthest"))


def phase1_weights(spark, sf):
    weighted = _triplets(spark, sf).withColumn("weight", S.phase1_weight(F.col("negative_distance"), F.col("excluded"), ALPHA))
    return weighted.groupBy("anchor_idx", "positive_idx").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count_if(F.col("weight") == 0).alias("n_zero"))


def scheduler_weights(spark, sf):
    weighted = S.scheduler_weight(_triplets(spark, sf), ["anchor_idx", "positive_idx"], "negative_distance", "excluded", ALPHA, 4.0)
    return weighted.groupBy("anchor_idx", "positive_idx").agg(F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


def _sans(spark, sf):
    return S.sans_weight(_triplets(spark, sf), ["anchor_idx", "positive_idx"], F.col("negative_distance"))


def sans_weights(spark, sf):
    return _sans(spark, sf).groupBy("anchor_idx", "positive_idx", "near").agg(F.count("*").alias("n"), F.round(F.max("weight"), 8).alias("weight"))


def sans_metadata(spark, sf):
    weighted = _sans(spark, sf)
    group = ["anchor_idx", "positive_idx"]
    meta = S.sans_metadata(weighted, S.weighted_top(weighted, group, "weight", 1 << 30, 42, list(KEYS)), group)
    return S.metadata_totals(meta).select(
        *["candidates_near", "candidates_far", "sampled_near", "sampled_far"],
        F.round("effective_near_weight", 6).alias("effective_near_weight"), F.round("effective_far_weight", 6).alias("effective_far_weight"),
    )


def phase1_sample(spark, sf):
    return S.text_sample(_triplets(spark, sf), "phase1", 8, 42, ALPHA).select(*KEYS, F.round("weight", 8).alias("weight"), "explicit_exclusion")


def sans_sample(spark, sf):
    return S.text_sample(_triplets(spark, sf), "sans", 8, 42).select(*KEYS, "near", F.round("weight", 8).alias("weight"))


def uniform_sample(spark, sf):
    return S.text_sample(_triplets(spark, sf), "uniform", 8, 42).select(*KEYS)


def weighted_topn(spark, sf):
    return S.graph_sample(_triplets(spark, sf), 4, 8, 42).select(*KEYS, F.round("sample_wgt", 8).alias("sample_wgt"))


def margin_weights(spark, sf):
    weighted = S.margin_weight(_triplets(spark, sf))
    return weighted.groupBy("anchor_idx").agg(F.round(F.sum("sample_wgt"), 5).alias("sample_wgt"), F.round(F.sum("relation_margin"), 4).alias("relation_margin"))


def nested_negatives(spark, sf):
    return S.nested(_triplets(spark, sf)).select(
        "anchor_idx", "positive_idx", "n_negatives", F.aggregate("negatives", F.lit(0).cast("long"), lambda s, x: s + x["negative_idx"]).alias("checksum")
    )


def multi_level_positives(spark, sf):
    nodes = supplier_nodes(spark, sf)
    lists = S.nested(R.Layout(nodes, exclusions(nodes)).triplets())
    return S.multi_level(lists, T.ancestors(nodes)).select("anchor_code", "positive_code", "steps", "n_negatives")


def padded_negatives(spark, sf):
    ids = F.transform("negatives", lambda x: x["negative_idx"])
    rows = S.nested(_triplets(spark, sf)).withColumn("ids", F.array_sort(ids))
    return rows.select("anchor_idx", "positive_idx", F.array_join(S.padded(F.col("ids"), 24), ",").alias("negatives"))


def curriculum_negatives(spark, sf):
    entry = F.struct(F.col("negative_idx").alias("idx"), F.col("negative_relation").alias("relation"), F.col("negative_distance").alias("distance"))
    lists = _triplets(spark, sf).groupBy("anchor_idx", "positive_idx").agg(F.array_sort(F.collect_list(entry)).alias("negatives"))
    kept = S.curriculum_filter(F.col("negatives"), 8, 4.0)
    return lists.select("anchor_idx", "positive_idx", F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + x["idx"]).alias("checksum"), F.size(kept).alias("n"))


def difficulty_weights(spark, sf):
    weighted = _triplets(spark, sf).withColumn("w", S.difficulty_weight(F.col("margin")))
    return weighted.groupBy("anchor_idx").agg(F.round(F.sum("w"), 5).alias("weight"), F.count("*").alias("n"))


def train_split(spark, sf):
    nodes = customer_nodes(spark, sf)
    return S.ordered_split(nodes, ["index"]).select("index", "code", "split")


def worker_shards(spark, sf):
    return customer_nodes(spark, sf).groupBy(S.shard(F.col("index"), 4).alias("worker")).agg(F.count("*").alias("n"), F.sum("index").alias("checksum"))


QUERIES = {
    f.__name__: f
    for f in (
        positive_pairs, negative_pairs, triplet_margins, triplet_stats, triplet_stats_large, triplets_capped, triplets_partition_scan, filtered_candidates,
        phase1_weights, scheduler_weights, sans_weights, sans_metadata, phase1_sample, sans_sample, uniform_sample, weighted_topn, margin_weights,
        nested_negatives, multi_level_positives, padded_negatives, curriculum_negatives, difficulty_weights, train_split, worker_shards,
    )
}

_TRIPLETS = f"""{SUPPLIER_TAX}, {PAIRS_EXCLUDED}, pos AS (
  SELECT idx_i AS anchor_idx, idx_j AS positive_idx, code_i AS anchor_code, code_j AS positive_code, relation_id AS positive_relation, distance AS positive_distance
  FROM xpairs WHERE distance <> (SELECT max(distance) FROM xpairs)
), neg AS (
  SELECT idx_j AS negative_idx, code_i AS anchor_code, code_j AS negative_code, relation_id AS negative_relation, distance AS negative_distance FROM xpairs
), raw AS (
  SELECT pos.*, neg.negative_idx, neg.negative_code, negative_relation, negative_distance,
    CAST(negative_relation - positive_relation AS DOUBLE) AS rm0, negative_distance - positive_distance AS dm0
  FROM pos JOIN xpairs c ON c.code_i = positive_code JOIN neg ON neg.anchor_code = pos.anchor_code AND neg.negative_code = c.code_j
  WHERE positive_distance > 0
), margined AS (
  SELECT *, greatest(positive_distance, negative_distance) = 99.0 AS unrelated, least(positive_distance, negative_distance) = 0.0 AS excluded,
    CAST(CASE WHEN negative_distance = 0 THEN 0.1 WHEN negative_distance = 99 THEN 15.0 ELSE rm0 END AS DOUBLE) AS relation_margin,
    CAST(CASE WHEN negative_distance = 0 THEN 0.1 WHEN rm0 > 0 AND dm0 = 0 THEN 0.3333 WHEN rm0 > 0 AND dm0 = -0.5 THEN 0.6667
      WHEN negative_distance = 99 THEN 10.0 ELSE dm0 END AS DOUBLE) AS distance_margin
  FROM raw
), trip AS (
  SELECT *, 1 / (CAST(0.3333 AS DOUBLE) * relation_margin + CAST(0.6667 AS DOUBLE) * distance_margin) AS margin,
    CAST(length(anchor_code) AS INTEGER) AS anchor_level, CAST(length(positive_code) AS INTEGER) AS positive_level,
    {SCATTERED.replace('anchor_idx', 'CAST(anchor_idx AS BIGINT)')} AS scattered
  FROM margined WHERE relation_margin > 0 AND distance_margin > 0)"""
_DIGEST = """SELECT anchor_idx, anchor_level, count(*) AS n, count(*) FILTER (excluded) AS n_excluded, count(*) FILTER (unrelated) AS n_unrelated,
  round(sum(relation_margin), 4) AS relation_margin, round(sum(distance_margin), 4) AS distance_margin, round(sum(margin), 4) AS margin,
  CAST(sum(scattered) AS BIGINT) AS checksum FROM {} GROUP BY 1, 2"""
_NEAR = """near AS (SELECT anchor_idx, positive_idx, negative_distance <= 4.0 AS near, count(*) AS n FROM trip GROUP BY ALL),
sides AS (SELECT *, sum(n) FILTER (near) OVER w AS nn, sum(n) FILTER (NOT near) OVER w AS nf FROM near WINDOW w AS (PARTITION BY anchor_idx, positive_idx)),
sans AS (SELECT *, CAST(CASE WHEN near THEN 0.65 ELSE 0.35 END AS DOUBLE) / n
  / CAST(CASE WHEN nn IS NOT NULL THEN 0.65 ELSE 0 END + CASE WHEN nf IS NOT NULL THEN 0.35 ELSE 0 END AS DOUBLE) AS weight FROM sides)"""
_WEIGHT = "CASE WHEN excluded THEN 100.0::DOUBLE WHEN {0} THEN 0.0::DOUBLE WHEN negative_distance > 0 THEN pow(negative_distance, -1.5) ELSE 0.0::DOUBLE END"
_GROUP = "PARTITION BY anchor_idx, positive_idx"


def uniform_sql(*keys: str, seed: int = 42) -> str:
    """The draw of operators.sampling.uniform()."""
    return f"((CAST('0x' || substr(md5(concat_ws(',', {seed}, {', '.join(keys)})), 1, 12) AS BIGINT) + 0.5) / CAST(281474976710656 AS DOUBLE))"


def _drawn(source: str, weight: str, n: int = 8) -> str:
    """The rows that win the races of their pairs, from rows with a weight."""
    u = uniform_sql(*KEYS)
    return f"""summed AS (SELECT *, {weight} AS w0, sum({weight}) OVER ({_GROUP}) AS total FROM {source}),
      timed AS (SELECT *, CASE WHEN total > 0 THEN w0 ELSE 1.0::DOUBLE END AS w1 FROM summed),
      drawn AS (SELECT * FROM timed QUALIFY row_number() OVER ({_GROUP} ORDER BY CASE WHEN w1 > 0 THEN -ln({u}) / w1 ELSE CAST('infinity' AS DOUBLE) END, negative_idx) <= {n})"""


_LISTS = "lists AS (SELECT anchor_idx, positive_idx, anchor_code, positive_code, list(negative_idx ORDER BY negative_idx) AS ids FROM trip GROUP BY ALL)"

SQL = {
    "positive_pairs": f"WITH {_TRIPLETS} SELECT DISTINCT anchor_idx, positive_idx, anchor_code, positive_code, positive_distance FROM pos",
    "negative_pairs": f"WITH {_TRIPLETS} SELECT DISTINCT negative_idx, anchor_code, negative_code, negative_relation, negative_distance FROM neg",
    "triplet_margins": f"WITH {_TRIPLETS} {_DIGEST.format('trip')}",
    "triplet_stats": f"WITH {_TRIPLETS} SELECT positive_relation, negative_relation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM trip GROUP BY 1, 2",
    "triplets_capped": f"WITH {_TRIPLETS}, c AS (SELECT *, row_number() OVER (PARTITION BY anchor_idx, positive_idx, unrelated ORDER BY scattered, negative_idx) AS nth FROM trip) {_DIGEST.format('c').replace(' GROUP BY', ' WHERE NOT unrelated OR nth <= 20 GROUP BY')}",
    "triplets_partition_scan": f"WITH {_TRIPLETS} {_DIGEST.format('trip').replace(' GROUP BY', ' WHERE anchor_level IN (2, 3) GROUP BY')}",
    "filtered_candidates": f"WITH {_TRIPLETS} SELECT anchor_code, positive_code, count(*) AS n, max(negative_distance) AS farthest FROM trip WHERE anchor_level IN (3, 4) AND positive_level = 6 AND NOT excluded GROUP BY 1, 2",
    "phase1_weights": f"WITH {_TRIPLETS}, w AS (SELECT *, {_WEIGHT.format('negative_distance = 2')} AS weight FROM trip) SELECT anchor_idx, positive_idx, round(sum(weight), 6) AS weight, count(*) FILTER (weight = 0) AS n_zero FROM w GROUP BY 1, 2",
    "scheduler_weights": f"""WITH {_TRIPLETS}, w AS (SELECT *, {_WEIGHT.format('negative_distance BETWEEN 2 AND 4')} AS weight FROM trip),
      t AS (SELECT anchor_idx, positive_idx, sum(weight) AS s, max(weight) AS m, count(*) AS n FROM w GROUP BY 1, 2)
      SELECT anchor_idx, positive_idx, 1.0::DOUBLE AS total, round(CASE WHEN s > 0 THEN m / s ELSE 1.0::DOUBLE / n END, 6) AS top FROM t""",
    "phase1_sample": f"WITH {_TRIPLETS}, {_drawn('trip', _WEIGHT.format('negative_distance = 2'))} SELECT {', '.join(KEYS)}, round(w0, 8) AS weight, excluded AS explicit_exclusion FROM drawn",
    "uniform_sample": f"WITH {_TRIPLETS}, {_drawn('trip', '1.0::DOUBLE')} SELECT {', '.join(KEYS)} FROM drawn",
    "sans_sample": f"""WITH {_TRIPLETS}, {_NEAR}, t AS (SELECT trip.*, near, weight FROM trip JOIN sans ON trip.anchor_idx = sans.anchor_idx AND trip.positive_idx = sans.positive_idx AND (negative_distance <= 4.0) = near),
      {_drawn('t', 'weight')} SELECT {', '.join(KEYS)}, near, round(weight, 8) AS weight FROM drawn""",
    "weighted_topn": f"""WITH {_TRIPLETS}, p AS (SELECT DISTINCT anchor_idx, positive_idx FROM trip),
      few AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY anchor_idx ORDER BY {uniform_sql('anchor_idx', 'positive_idx')}, positive_idx) <= 4),
      t AS (SELECT trip.*, 2 / (relation_margin + distance_margin + CASE WHEN excluded THEN 2 ELSE 0 END) AS wgt FROM trip JOIN few USING (anchor_idx, positive_idx)),
      {_drawn('t', 'wgt')} SELECT {', '.join(KEYS)}, round(wgt, 8) AS sample_wgt FROM drawn""",
    "sans_weights": f"WITH {_TRIPLETS}, {_NEAR} SELECT anchor_idx, positive_idx, near, n, round(weight, 8) AS weight FROM sans",
    "sans_metadata": f"""WITH {_TRIPLETS}, {_NEAR}, g AS (SELECT anchor_idx, positive_idx, coalesce(sum(n) FILTER (near), 0) AS cn, coalesce(sum(n) FILTER (NOT near), 0) AS cf,
      coalesce(sum(n * weight) FILTER (near), 0) AS en, coalesce(sum(n * weight) FILTER (NOT near), 0) AS ef FROM sans GROUP BY 1, 2)
      SELECT CAST(sum(cn) AS BIGINT) AS candidates_near, CAST(sum(cf) AS BIGINT) AS candidates_far, CAST(sum(cn) AS BIGINT) AS sampled_near, CAST(sum(cf) AS BIGINT) AS sampled_far,
      round(avg(en), 6) AS effective_near_weight, round(avg(ef), 6) AS effective_far_weight FROM g""",
    "margin_weights": f"WITH {_TRIPLETS}, m AS (SELECT anchor_idx, relation_margin + CASE WHEN excluded THEN 1 ELSE 0 END AS r, distance_margin + CASE WHEN excluded THEN 1 ELSE 0 END AS d FROM trip) SELECT anchor_idx, round(sum(2 / (r + d)), 5) AS sample_wgt, round(sum(r), 4) AS relation_margin FROM m GROUP BY 1",
    "nested_negatives": f"WITH {_TRIPLETS} SELECT anchor_idx, positive_idx, CAST(count(*) AS INTEGER) AS n_negatives, CAST(sum(negative_idx) AS BIGINT) AS checksum FROM trip GROUP BY 1, 2",
    "multi_level_positives": f"""WITH {_TRIPLETS}, {_LISTS}, f AS (SELECT anchor_code, arg_min(positive_code, positive_idx) AS p, arg_min(len(ids), positive_idx) AS n FROM lists GROUP BY 1),
      up AS (SELECT code, unnest([substr(code, 1, 5), substr(code, 1, 4), substr(code, 1, 3), CASE substr(code, 1, 2) WHEN '32' THEN '31' WHEN '45' THEN '44' ELSE substr(code, 1, 2) END]) AS a, unnest([1, 2, 3, 4]) AS steps FROM nodes WHERE level = 6)
      SELECT anchor_code, a AS positive_code, CAST(steps AS INTEGER) AS steps, CAST(n AS INTEGER) AS n_negatives FROM f JOIN up ON anchor_code = code
      UNION ALL SELECT anchor_code, p, 0, CAST(n AS INTEGER) FROM f WHERE length(anchor_code) < 6""",
    "padded_negatives": f"WITH {_TRIPLETS}, {_LISTS} SELECT anchor_idx, positive_idx, array_to_string([ids[least(k, len(ids))] FOR k IN range(1, 25)], ',') AS negatives FROM lists",
    "curriculum_negatives": f"""WITH {_TRIPLETS}, l AS (SELECT anchor_idx, positive_idx, list(negative_idx ORDER BY negative_idx) AS every,
        coalesce(list(negative_idx ORDER BY negative_idx) FILTER (negative_relation <= 8 AND negative_distance <= 4), []) AS within FROM trip GROUP BY 1, 2)
      SELECT anchor_idx, positive_idx, CAST(CASE WHEN len(within) = 0 THEN list_sum(every) ELSE list_sum(within) + (len(every) - len(within)) * within[-1] END AS BIGINT) AS checksum, CAST(len(every) AS INTEGER) AS n FROM l""",
    "difficulty_weights": f"WITH {_TRIPLETS} SELECT anchor_idx, round(sum(greatest(margin, 1e-8)), 5) AS weight, count(*) AS n FROM trip GROUP BY 1",
    "train_split": f"""WITH {CUSTOMER_TAX} SELECT "index", code, CASE WHEN "index" < least(greatest(floor((SELECT count(*) FROM nodes) * 0.95), 1), (SELECT count(*) FROM nodes) - 1) THEN 'train' ELSE 'validation' END AS split FROM nodes""",
    "worker_shards": f'WITH {CUSTOMER_TAX} SELECT CAST("index" % 4 AS INTEGER) AS worker, count(*) AS n, CAST(sum("index") AS BIGINT) AS checksum FROM nodes GROUP BY 1',
}
