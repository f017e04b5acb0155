"""Queries of groups G (geometry), H (mining), I (clusters), J (losses) and K (metrics) over embeddings.

Tree distance of two vectors: 0.5 with the same label, 2 with the same half of the labels' pairs, else 4.
The hierarchy of vectors is a heap: the parent of id n is (n - 1) div 4.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators import cluster as K
from cladeworks.operators import evaluation as R
from cladeworks.operators import losses as L
from cladeworks.operators import metrics as E
from cladeworks.operators import mining as M
from cladeworks.operators import pair_folds as H
from cladeworks.operators import pair_lists as T
from cladeworks.operators import pair_order as O
from cladeworks.operators import pair_ranks as Q
from cladeworks.operators import pairwise as P
from cladeworks.operators.pair_stats import PairStatistics, collapse
from cladeworks.plans.binding import VECTORS, vectors
from cladeworks.sources.stages import staged

K_NEGATIVES = 5
WINDOW = 20
EXPERTS = 8


def _tree(a, b):
    """Tree distances of arrays of labels."""
    return np.where(a == b, 0.5, np.where(np.floor(a / 2) == np.floor(b / 2), 2.0, 4.0))


def _statistics(spark, sf):
    return PairStatistics(vectors(spark, sf), "lorentz", _tree, "x")


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _heap(vecs):
    level = (F.floor(F.log(3.0 * F.col("id") + 1) / F.log(F.lit(4.0)) + 1e-9) + 1).cast("int")
    nodes = vecs.select("id", level.alias("level"), V.radius(F.col("x")).alias("radius"))
    edges = vecs.where("id > 0").select(F.floor((F.col("id") - 1) / 4).alias("parent"), F.col("id").alias("child"))
    return nodes, edges


# --- geometry

def lorentz_lift(spark, sf):
    v = vectors(spark, sf)
    return _rounded(v.select("id", V.radius(F.col("x")).alias("time"), V.norm(F.col("v")).alias("norm"), V.lorentz_dot(F.col("x"), F.col("x")).alias("product")))


def exp_log_roundtrip(spark, sf):
    v = vectors(spark, sf).select("id", F.col("v"), V.exp_zero(V.capped(F.col("v"), 3.0)).alias("e"))
    back = V.space(V.log_zero(F.col("e")))
    return _rounded(v.select("id", F.col("e")[0].alias("time"), V.norm(back).alias("norm"), V.euclidean(back, V.capped(F.col("v"), 3.0)).alias("error")))


def manifold_check(spark, sf):
    v = vectors(spark, sf).withColumn("off", V.off_manifold(F.col("x")))
    return _rounded(v.agg(F.count("*").alias("n"), F.count_if(F.col("off") < 1e-6).alias("n_valid"), F.min(V.radius(F.col("x"))).alias("least"), F.max(V.radius(F.col("x"))).alias("most")))


def parallel_transport(spark, sf):
    v = vectors(spark, sf)
    x, y = v.select("id", "x"), v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    moved = x.join(y, "id").select("id", "x", "y", V.transported(V.log_zero(F.col("y")), F.col("x"), F.col("y")).alias("m"))
    return _rounded(moved.select("id", F.col("m")[0].alias("time"), V.lorentz_dot(F.col("m"), F.col("m")).alias("square")), 5)


def radius_by_label(spark, sf):
    r = vectors(spark, sf).select("label", V.radius(F.col("x")).alias("r"), M.lorentz_norm(F.col("x")).alias("norm"))
    return _rounded(r.groupBy("label").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("least"), F.max("r").alias("most"), F.avg("norm").alias("norm")))


def lorentz_pairs(spark, sf):
    return _rounded(P.all_pairs(vectors(spark, sf), "lorentz", "x"))


def cosine_pairs(spark, sf):
    return _rounded(P.all_pairs(vectors(spark, sf), "cosine"))


def euclid_pairs(spark, sf):
    return _rounded(P.all_pairs(vectors(spark, sf), "euclidean"))


def similarity_hist(spark, sf):
    # half away from zero, as Spark rounds
    return H.histogram(vectors(spark, sf), "cosine_similarity", lambda x: np.copysign(np.floor(np.abs(x * 5) + 0.5), x))


# --- mining

def knn_lorentz(spark, sf):
    v = vectors(spark, sf)
    return _rounded(P.nearest(v, 10, "lorentz", vector="x", least=1.0).select("id_i", "id_j", F.col("nth").cast("long").alias("nth"), F.col("value").alias("d")))


def hard_negatives(spark, sf):
    v = vectors(spark, sf)
    found = M.hard_negatives(v.where("label < 5"), v.where("label >= 5"), K_NEGATIVES)
    return _rounded(found.select("id_i", "id_j", F.col("nth").cast("long").alias("nth"), F.col("value").alias("d")))


def _gates(v):
    return V.softmax(F.slice(F.col(v), 1, EXPERTS))


def _candidates(v, beside=None):
    """Candidates of an anchor: the twenty vectors nearest to it, out of all of them."""
    return P.nearest(v, WINDOW, "lorentz", vector="x", least=1.0, beside=beside).withColumnsRenamed({"id_i": "anchor", "id_j": "negative", "value": "d"})


def _space_cosines(x, y):
    """Cosines of the space parts of rows."""
    x, y = x[:, 1:], y[:, 1:]
    return (x * y).sum(1) / (np.maximum(np.linalg.norm(x, axis=1), 1e-12) * np.maximum(np.linalg.norm(y, axis=1), 1e-12))


def _gated(v):
    return v.select("id", _gates("v").alias("g"))


def router_confusion_topk(spark, sf):
    found = M.router_nearest(_gated(vectors(spark, sf)), K_NEGATIVES)
    return _rounded(found.select("anchor", "negative", F.col("nth").cast("long").alias("nth"), "score"), 5)


def router_mix(spark, sf):
    v = vectors(spark, sf)
    hard = M.hard_negatives(v, v, 6).select(F.col("id_i").alias("anchor"), F.col("id_j").alias("negative"), "nth")
    return M.router_mix(M.router_nearest(_gated(v), 6, "cosine"), hard, 6)


def norm_adaptive_margin(spark, sf):
    return _rounded(vectors(spark, sf).select("id", V.adaptive_margin(F.col("x"), 0.5).alias("margin")))


def false_negative_mask(spark, sf):
    v = vectors(spark, sf)
    c = _candidates(v).select("anchor", "negative")
    return M.false_negatives(c, v.where("label <> 3").select("id", "label")).select("anchor", "negative", "false_negative")


def false_negative_loss(spark, sf):
    v = vectors(spark, sf)
    c = _candidates(v, _space_cosines).select("anchor", "negative", F.col("beside").alias("cosine"))
    return _rounded(M.false_negative_loss(M.false_negatives(c, v.select("id", "label")), "hybrid"))


def pseudo_labels(spark, sf):
    v = vectors(spark, sf)
    return M.pseudo_labels(v.select((F.col("id") % 50).alias("code"), "label", F.col("id").alias("ord")))


def moe_topk_gates(spark, sf):
    v = vectors(spark, sf).select("id", F.explode(M.gates(F.slice(F.col("v"), 1, EXPERTS), 2)).alias("g"))
    return _rounded(v.select("id", "g.expert", "g.weight"))


def load_balance(spark, sf):
    return _rounded(M.load_balance(vectors(spark, sf).select(F.slice(F.col("v"), 1, EXPERTS).alias("logits")), EXPERTS, 2))


def router_entropy(spark, sf):
    return _rounded(vectors(spark, sf).agg(F.avg(L.entropy(_gates("v"))).alias("entropy")))


def nearest_softmax(spark, sf):
    c = _candidates(vectors(spark, sf)).select("anchor", "negative", "d")
    return _rounded(M.nearest_softmax(c, 0.5, 0.7).select("anchor", "negative", "weight"))


def edge_attention(spark, sf):
    """Messages along heap edges both ways: softmax attention per target of an edge score, weighted sum of tangents."""
    v = vectors(spark, sf)
    _, edges = _heap(v)
    both = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("w")).unionByName(
        edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(0.5).alias("w"))
    )
    scored = L.softmax_by(both.withColumn("score", F.log(F.greatest("w", F.lit(1e-6))) + (F.col("src") % 3) * 0.1), "dst", F.col("score"))
    t = v.select(F.col("id").alias("src"), V.log_zero(F.col("x"))[1].alias("t1"))
    return _rounded(scored.join(t, "src").groupBy("dst").agg(F.sum(F.col("attention") * F.col("t1")).alias("message"), F.sum("attention").alias("total")))


# --- clusters

def kmeans_assign(spark, sf):
    v = vectors(spark, sf)
    centres = v.where("id < 8").select(F.col("id").cast("int").alias("cluster"), F.col("x").alias("centre"))
    near = K.assign(v, centres)
    return _rounded(near.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia"), F.sum("id").alias("checksum")), 4)


def frechet_means(spark, sf):
    v = vectors(spark, sf).select(F.col("label").alias("cluster"), "x")
    return _rounded(K.means(v).select("cluster", F.col("centre")[0].alias("time"), F.col("centre")[5].alias("fifth")))


def kmeans_fit(spark, sf):
    v = vectors(spark, sf)
    centres, inertia = K.fit(v, 8)
    return K.assign(v, K.centre_frame(spark, np.asarray(centres))).select("id", "cluster", F.lit(inertia).alias("inertia"))


def cluster_agreement(spark, sf):
    v = vectors(spark, sf).select("label", (F.col("id") % 7).alias("other"))
    return _rounded(K.agreement(v, "label", "other"))


# --- losses

def _rows(spark, sf):
    """Anchors with the distance to the nearest vector of their label as positive, and to the nineteen nearest others, or all there are, as negatives."""
    v = vectors(spark, sf)
    near = P.nearest_in_and_out(v, 1, WINDOW - 1, "lorentz", "label", vector="x", least=1.0)
    dn = F.transform(F.array_sort(F.collect_list(F.when(~F.col("inside"), F.struct("nth", "value")))), lambda x: x["value"])
    both = near.groupBy(F.col("id_i").alias("anchor")).agg(F.min(F.when(F.col("inside"), F.col("value"))).alias("dp"), dn.alias("dn"))
    return both.where(F.col("dp").isNotNull() & (F.size("dn") > 0))


def dcl_loss(spark, sf):
    masked = F.transform("dn", lambda x, i: (i + F.col("anchor")) % 6 == 0)
    return _rounded(L.contrastive(_rows(spark, sf).withColumn("masked", masked), 0.5, 0.1))


def triplet_loss(spark, sf):
    rows = _rows(spark, sf).select("anchor", "dp", F.posexplode("dn").alias("i", "dn"))
    loss = L.triplet(F.col("dp"), F.col("dn"), 0.5, 0.8)
    return _rounded(rows.agg(F.avg(loss).alias("loss"), L.weighted_mean(loss, (F.col("i") % 3 + 1).cast("double")).alias("weighted")))


def level_radius_loss(spark, sf):
    v = vectors(spark, sf)
    return _rounded(v.agg(F.avg(L.level_radius(F.col("x"), F.col("label") % 5 + 2)).alias("loss"), L.radius_penalty(F.col("x"), 0.01, 0.9).alias("penalty")))


def hierarchy_loss(spark, sf):
    return _rounded(_statistics(spark, sf).hierarchy_preservation(0.325))


def rank_order_loss(spark, sf):
    return _rounded(T.rank_order(vectors(spark, sf), _tree))


def lambdarank_loss(spark, sf):
    return _rounded(T.lambda_rank(vectors(spark, sf), _tree, lambda t: 4.5 - t))


WEIGHTS = {"contrastive": 1.0, "balance": 0.01, "hierarchy": 1.0, "rank": 0.275, "radius": 1.0}


def _terms(spark, sf):
    parts = {
        "contrastive": dcl_loss(spark, sf).select("loss"), "balance": load_balance(spark, sf).select(F.col("load_balance").alias("loss")), "hierarchy": hierarchy_loss(spark, sf),
        "rank": rank_order_loss(spark, sf).select("loss"), "radius": level_radius_loss(spark, sf).select(F.col("penalty").alias("loss")),
    }
    out = None
    for name, one in parts.items():
        row = one.select(F.lit(name).alias("name"), "loss")
        out = row if out is None else out.unionByName(row)
    return out


def total_loss(spark, sf):
    """All loss terms by their weights, and weighted by their uncertainties (here 0, 0.1, 0.2 and so on)."""
    terms = staged(_terms(spark, sf), "loss-terms")  # five rows, read twice
    s = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(WEIGHTS) for x in (n, i / 10)]), F.col("name"))
    both = L.weighted_total(terms, WEIGHTS).crossJoin(L.uncertainty_total(terms.withColumn("s", s)).withColumnRenamed("total", "uncertain"))  # one row each
    return _rounded(both, 5)


def attention_layers(spark, sf):
    """Two rounds of messages along the heap's edges, both ways."""
    v = vectors(spark, sf)
    _, edges = _heap(v)
    both = edges.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(0.0).alias("score")).unionByName(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit(0.5).alias("score")))
    x = F.col("x")
    return _rounded(L.attention_layers(v.select("id", "x"), both, 2).select("id", x[0].alias("time"), x[1].alias("first")), 5)


def lorentz_curved(spark, sf):
    """Nearest neighbours at another curvature: the order is the same, distances are scaled."""
    v = vectors(spark, sf)
    near = P.nearest(v, 3, "lorentz", vector="x", least=1.0, c=2.0)
    return _rounded(near.select("id_i", "id_j", F.col("nth").cast("long").alias("nth"), F.col("value").alias("d")))


def adaptive_margin(spark, sf):
    margins = lambda d, t: [L.graph_margins(0.5, 0.4, d, t), L.confidence_margins(0.5, 1 - np.clip(d / 10, 0.0, 1.0), t / 4)]
    s = H.by_tree(vectors(spark, sf), "lorentz", _tree, margins, 2)
    return _rounded(s.select("t", (F.col("s")[0] / F.col("n")).alias("graph"), (F.col("s")[1] / F.col("n")).alias("confident"), "n"))


def phase_losses(spark, sf):
    rows = _rows(spark, sf).select("anchor", "dp", F.explode("dn").alias("dn"))
    base = L.triplet(F.col("dp"), F.col("dn"), 1.0)
    per = rows.groupBy((F.col("anchor") % 4 + 1).alias("phase")).agg(F.avg(base).alias("base"), F.avg("dn").alias("adversarial"), L.distillation(F.col("dp"), F.col("dn")).alias("distilled"))
    return _rounded(per.select("phase", L.phase_loss(F.col("phase"), F.col("base"), F.col("adversarial"), F.col("distilled")).alias("loss")))


# --- metrics

def precision_recall_at_k(spark, sf):
    return _rounded(R.retrieval(vectors(spark, sf), (5, 10, 20)))


def map_score(spark, sf):
    return _rounded(T.mean_average_precision(vectors(spark, sf), _tree, 0.5))


def ndcg_at_k(spark, sf):
    return _rounded(Q.ndcg(vectors(spark, sf), _tree, lambda t, top: 4.0 - t, (10,)).groupBy("k").agg(F.avg("ndcg").alias("ndcg"), F.min("ndcg").alias("least")))


def ndcg_ranking(spark, sf):
    return _rounded(Q.ndcg_ranking(vectors(spark, sf), _tree))


def cophenetic(spark, sf):
    return _rounded(_statistics(spark, sf).cophenetic())


def spearman_ordinal(spark, sf):
    return _rounded(O.spearman(vectors(spark, sf), _tree, digits=9))


def distortion(spark, sf):
    return _rounded(_statistics(spark, sf).distortion())


def collapse_check(spark, sf):
    v = vectors(spark, sf)
    dims = v.select(F.posexplode("v").alias("i", "e")).groupBy("i").agg(F.var_samp("e").alias("v"))
    return _rounded(collapse(v, V.norm(F.col("v")), dims))


def radius_structure(spark, sf):
    return _rounded(E.radius_structure(*_heap(vectors(spark, sf))))


def retrieval_parent_child_sibling(spark, sf):
    v = vectors(spark, sf)
    return _rounded(Q.hierarchy_retrieval(v, _heap(v)[1], 5, 20))


def taxonomy_reconstruction(spark, sf):
    v = vectors(spark, sf)
    return _rounded(Q.taxonomy_reconstruction(v, *_heap(v)))


def industry_similarity(spark, sf):
    v = vectors(spark, sf)
    return _rounded(Q.sibling_similarity(v, _heap(v)[1]))


def downstream_suite(spark, sf):
    """Reconstruction, similarity, agreement of the labels with ids modulo 7, and classification over the same vectors."""
    v = vectors(spark, sf)
    clusters = v.select("label", (F.col("id") % 7).alias("cluster"))
    return _rounded(R.downstream(*_heap(v), v, clusters))


def evaluation_run(spark, sf):
    """All metrics of an epoch over the lifted vectors."""
    return _rounded(R.evaluate(vectors(spark, sf), _tree, 0.5))


def validation_metrics(spark, sf):
    return _rounded(E.validation(_rows(spark, sf), 3))


def verify_before_after(spark, sf):
    """Metrics of the first half of the dimensions against those of all of them."""
    v = vectors(spark, sf)
    half = v.withColumn("x", V.lift(F.slice("v", 1, 32)))

    def bundle(vecs):
        coph = PairStatistics(vecs, "lorentz", _tree, "x").cophenetic().select(F.lit("cophenetic").alias("metric"), F.col("correlation").alias("value"))
        ndcg = Q.ndcg_ranking(vecs, _tree, (10,)).select(F.lit("ndcg_10").alias("metric"), F.col("ndcg").alias("value"))
        parents = Q.hierarchy_retrieval(vecs, _heap(vecs)[1], 10).select(F.lit("parent_retrieval").alias("metric"), F.col("parent_retrieval").alias("value"))
        return coph.unionByName(ndcg).unionByName(parents)

    return _rounded(E.verify_change(bundle(half), bundle(v), {"cophenetic": 0.02, "ndcg_10": 0.01, "parent_retrieval": 0.05}))


QUERIES = {
    f.__name__: f
    for f in (
        lorentz_lift, exp_log_roundtrip, manifold_check, parallel_transport, radius_by_label, lorentz_pairs, cosine_pairs, euclid_pairs, similarity_hist,
        knn_lorentz, hard_negatives, router_confusion_topk, router_mix, norm_adaptive_margin, false_negative_mask, false_negative_loss, pseudo_labels,
        moe_topk_gates, load_balance, router_entropy, nearest_softmax, edge_attention, kmeans_assign, frechet_means, kmeans_fit, cluster_agreement,
        lorentz_curved, total_loss, attention_layers, dcl_loss, triplet_loss, level_radius_loss, hierarchy_loss, rank_order_loss, lambdarank_loss, adaptive_margin, phase_losses,
        precision_recall_at_k, map_score, ndcg_at_k, ndcg_ranking, cophenetic, spearman_ordinal, distortion, collapse_check, radius_structure,
        retrieval_parent_child_sibling, taxonomy_reconstruction, industry_similarity, validation_metrics, verify_before_after, downstream_suite, evaluation_run,
    )
}

# --- SQL

_DOT = "(list_inner_product({0}, {1}) - 2 * {0}[1] * {1}[1])"
_D = "acosh(greatest(-" + _DOT + ", {2}))"
_T = "CAST(CASE WHEN a.label = b.label THEN 0.5 WHEN a.label // 2 = b.label // 2 THEN 2.0 ELSE 4.0 END AS DOUBLE)"
_ALL = VECTORS + f", both_ways AS (SELECT a.id AS id_i, b.id AS id_j, {_D.format('a.x', 'b.x', '1.00001')} AS d, {_T} AS t FROM lifted a JOIN lifted b ON a.id <> b.id), once AS (SELECT * FROM both_ways WHERE id_i < id_j)"
_RANKS = _ALL + ", ranks AS (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth FROM both_ways)"
_NORM = "sqrt(list_inner_product(v, v))"
_MAPPED = "mapped AS (SELECT id, v, {n} AS n FROM vec)"
_SOFTMAX = "[exp(e - list_max(v[1:8])) / list_sum([exp(f - list_max(v[1:8])) FOR f IN v[1:8]]) FOR e IN v[1:8]]"
_NEAR = VECTORS + f""", gated AS (SELECT id, label, x, v, {_SOFTMAX} AS g FROM lifted),
every AS (SELECT a.id AS anchor, b.id AS negative, a.g AS ga, b.g AS gn, a.v AS va, b.v AS vn, a.label AS la, b.label AS lb, {_D.format('a.x', 'b.x', '1.0')} AS d
  FROM gated a JOIN gated b ON a.id <> b.id)"""
_CAND = _NEAR + ", cand AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d, negative) <= 20)"
_SMOOTH = "[(e + 1e-8) / (list_sum({0}) + 8e-8) FOR e IN {0}]"
_ROWS = _NEAR + """, pos AS (SELECT anchor, min(d) AS dp FROM every WHERE la = lb GROUP BY 1),
neg AS (SELECT anchor, d, negative FROM every WHERE la <> lb QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY d, negative) <= 19),
r AS (SELECT anchor, any_value(dp) AS dp, list(d ORDER BY d, negative) AS dn FROM pos JOIN neg USING (anchor) GROUP BY 1)"""
_HEAP = "heap AS (SELECT id, CAST(floor(ln(3.0::DOUBLE * id + 1) / ln(4.0::DOUBLE) + 1e-9) + 1 AS INTEGER) AS level, x[1] AS radius FROM lifted), edges AS (SELECT (id - 1) // 4 AS parent, id AS child FROM lifted WHERE id > 0)"
_TANGENT = "[acosh(greatest(x[1], 1.00001)) / sinh(acosh(greatest(x[1], 1.00001))) * e FOR e IN x[2:]]"


def _pr(k):
    return f"SELECT {k} AS k, round(avg(hits / {k}.0::DOUBLE), 6) AS precision, round(avg(hits / greatest(total, 1)), 6) AS recall FROM (SELECT id_i, CAST(count(*) FILTER (nth <= {k} AND t = 0.5) AS DOUBLE) AS hits, count(*) FILTER (t = 0.5) AS total FROM ranks GROUP BY 1)"


def _ndcg(k, source="graded"):
    return f"SELECT id_i, {k} AS k, sum(CASE WHEN nth <= {k} THEN rel / log2(nth + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= {k} THEN rel / log2(ideal + 1) ELSE 0 END), 0) AS ndcg FROM {source} GROUP BY 1"


_GRADED = "graded AS (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY rel DESC, id_j) AS ideal FROM (SELECT *, {} AS rel FROM ranks))"
_SIBS = "sibs AS (SELECT a.child AS id_i, b.child AS id_j FROM edges a JOIN edges b ON a.parent = b.parent AND a.child <> b.child)"


def _pairs_sql(value):
    return f"WITH {VECTORS} SELECT a.id AS id_i, b.id AS id_j, round({value}, 6) AS value FROM lifted a JOIN lifted b ON a.id < b.id"


_COSINE = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"

SQL = {
    "lorentz_lift": f"WITH {VECTORS} SELECT id, round(x[1], 6) AS time, round({_NORM}, 6) AS norm, round({_DOT.format('x', 'x')}, 6) AS product FROM lifted",
    "exp_log_roundtrip": f"""WITH {VECTORS}, c AS (SELECT id, least(1.0, 3.0 / greatest({_NORM}, 1e-8)) * {_NORM} AS n FROM vec)
      SELECT id, round(cosh(n), 6) AS time, round(acosh(greatest(cosh(n), 1.00001)), 6) AS norm, round(abs(acosh(greatest(cosh(n), 1.00001)) - n), 6) AS error FROM c""",
    "manifold_check": f"WITH {VECTORS} SELECT count(*) AS n, count(*) FILTER (abs({_DOT.format('x', 'x')} + 1) < 1e-6) AS n_valid, round(min(x[1]), 6) AS least, round(max(x[1]), 6) AS most FROM lifted",
    "parallel_transport": f"""WITH {VECTORS}, t AS (SELECT id, x, list_concat([0.0::DOUBLE], {_TANGENT}) AS u FROM lifted),
      p AS (SELECT a.id, b.u, a.x, b.x AS y, {_DOT.format('b.x', 'b.u')} / (greatest(-{_DOT.format('a.x', 'b.x')}, 1.0) + 1) AS k FROM t a JOIN t b ON b.id = a.id + 1),
      m AS (SELECT id, [u[i] + k * (x[i] + y[i]) FOR i IN range(1, len(x) + 1)] AS m FROM p)
      SELECT id, round(m[1], 5) AS time, round({_DOT.format('m', 'm')}, 5) AS square FROM m""",
    "radius_by_label": f"WITH {VECTORS} SELECT label, count(*) AS n, round(avg(x[1]), 6) AS mean, round(stddev_samp(x[1]), 6) AS std, round(min(x[1]), 6) AS least, round(max(x[1]), 6) AS most, round(avg(sqrt(greatest(x[1] * x[1] - list_inner_product(v, v), 1e-8))), 6) AS norm FROM lifted GROUP BY 1",
    "lorentz_pairs": _pairs_sql(_D.format("a.x", "b.x", "1.00001")),
    "cosine_pairs": _pairs_sql(f"1 - {_COSINE}"),
    "euclid_pairs": _pairs_sql("list_distance(a.v, b.v)"),
    "similarity_hist": f"WITH {VECTORS} SELECT CAST(round({_COSINE} * 5) AS INTEGER) AS bin, count(*) AS n FROM vec a JOIN vec b ON a.id < b.id GROUP BY 1",
    "knn_lorentz": f"WITH {VECTORS}, p AS (SELECT a.id AS id_i, b.id AS id_j, {_D.format('a.x', 'b.x', '1.0')} AS d FROM lifted a JOIN lifted b ON a.id <> b.id) SELECT id_i, id_j, nth, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth FROM p) WHERE nth <= 10",
    "hard_negatives": f"WITH {VECTORS}, p AS (SELECT a.id AS id_i, b.id AS id_j, {_D.format('a.x', 'b.x', '1.0')} AS d FROM lifted a JOIN lifted b ON a.label < 5 AND b.label >= 5) SELECT id_i, id_j, nth, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth FROM p) WHERE nth <= 5",
    "router_confusion_topk": f"""WITH {_NEAR}, s AS (SELECT anchor, negative, {_SMOOTH.format('ga')} AS p, {_SMOOTH.format('gn')} AS q FROM every),
      k AS (SELECT anchor, negative, -list_sum([p[i] * ln(p[i] / q[i]) FOR i IN range(1, 9)]) AS score FROM s)
      SELECT anchor, negative, nth, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, negative) AS nth FROM k) WHERE nth <= 5""",
    "router_mix": f"""WITH {_NEAR}, s AS (SELECT anchor, negative, row_number() OVER (PARTITION BY anchor ORDER BY list_cosine_similarity(ga, gn) DESC, negative) AS r,
      row_number() OVER (PARTITION BY anchor ORDER BY d, negative) AS h FROM every)
      SELECT anchor, negative, 'router' AS origin FROM s WHERE r <= 3 UNION ALL SELECT anchor, negative, 'hard' FROM s WHERE h <= 3""",
    "norm_adaptive_margin": f"WITH {VECTORS} SELECT id, round(0.5 / cosh(acosh(greatest(x[1], 1.000001))), 6) AS margin FROM lifted",
    "false_negative_mask": f"WITH {_CAND} SELECT anchor, negative, la = lb AND la <> 3 AS false_negative FROM cand",
    "false_negative_loss": f"WITH {_CAND} SELECT count(*) FILTER (la <> lb) AS n_negatives, count(*) FILTER (la = lb) AS n_false, round(avg(1 - list_cosine_similarity(va, vn)) FILTER (la = lb), 6) AS attraction FROM cand",
    "pseudo_labels": f"WITH {VECTORS} SELECT id % 50 AS code, arg_max(label, id) AS label FROM vec GROUP BY 1",
    "moe_topk_gates": f"""WITH {VECTORS}, g AS (SELECT id, unnest(v[1:8]) AS l, unnest(range(0, 8)) AS e FROM vec), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l DESC, e) AS nth FROM g)
      SELECT id, CAST(e AS INTEGER) AS expert, round(exp(l) / sum(exp(l)) OVER (PARTITION BY id), 6) AS weight FROM t WHERE nth <= 2""",
    "load_balance": f"""WITH {VECTORS}, g AS (SELECT id, unnest(v[1:8]) AS l, unnest({_SOFTMAX}) AS p, unnest(range(0, 8)) AS e FROM vec), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l DESC, e) AS nth FROM g),
      a AS (SELECT e, count(*) FILTER (nth <= 2) / CAST(count(*) AS DOUBLE) AS f, avg(p) AS p FROM t GROUP BY 1) SELECT round(8 * sum(f * p), 6) AS load_balance, round(max(f), 6) AS top_share FROM a""",
    "router_entropy": f"WITH {VECTORS}, g AS (SELECT {_SOFTMAX} AS g FROM vec) SELECT round(avg(-list_sum([e * ln(greatest(e, 1e-10)) FOR e IN g])), 6) AS entropy FROM g",
    "nearest_softmax": f"""WITH {_CAND}, n AS (SELECT anchor, negative, d, row_number() OVER (PARTITION BY anchor ORDER BY d, negative) AS nth, count(*) OVER (PARTITION BY anchor) AS n, min(d) OVER (PARTITION BY anchor) AS m FROM cand),
      w AS (SELECT *, CASE WHEN nth <= greatest(floor(n * 0.5), 1) THEN exp(-(d - m) / 0.7) ELSE 0 END AS w FROM n) SELECT anchor, negative, round(w / sum(w) OVER (PARTITION BY anchor), 6) AS weight FROM w""",
    "edge_attention": f"""WITH {VECTORS}, {_HEAP}, b AS (SELECT parent AS src, child AS dst, 1.0 AS w FROM edges UNION ALL SELECT child, parent, 0.5 FROM edges),
      s AS (SELECT src, dst, exp(ln(w) + (src % 3) * 0.1) AS s FROM b), a AS (SELECT src, dst, s / sum(s) OVER (PARTITION BY dst) AS a FROM s)
      SELECT dst, round(sum(a * ({_TANGENT})[1]), 6) AS message, round(sum(a), 6) AS total FROM a JOIN lifted ON id = src GROUP BY 1""",
    "kmeans_assign": f"""WITH {VECTORS}, d AS (SELECT a.id, c.id AS c, {_D.format('a.x', 'c.x', '1.0')} AS d FROM lifted a, lifted c WHERE c.id < 8), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, c) AS nth FROM d)
      SELECT CAST(c AS INTEGER) AS cluster, count(*) AS n, round(sum(d * d), 4) AS inertia, CAST(sum(id) AS BIGINT) AS checksum FROM n WHERE nth = 1 GROUP BY 1""",
    "frechet_means": f"""WITH {VECTORS}, t AS (SELECT label, unnest({_TANGENT}) AS e, unnest(range(1, 65)) AS i FROM lifted), m AS (SELECT label, i, avg(e) AS m FROM t GROUP BY 1, 2),
      n AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-8) AS n, max(m) FILTER (i = 5) AS fifth FROM m GROUP BY 1)
      SELECT label AS cluster, round(cosh(least(n, 40)), 6) AS time, round(sinh(least(n, 40)) / n * fifth, 6) AS fifth FROM n""",
    "cluster_agreement": f"""WITH {VECTORS}, c AS (SELECT label AS a, id % 7 AS b, CAST(count(*) AS DOUBLE) AS n FROM vec GROUP BY 1, 2), a AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1),
      t AS (SELECT sum(n) AS t FROM c), j AS (SELECT sum(n * (n - 1) / 2) AS bo, sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN a USING (a) JOIN b USING (b), t),
      x AS (SELECT sum(na * (na - 1) / 2) AS pa, sum(-na / t * ln(na / t)) AS ha FROM a, t), y AS (SELECT sum(nb * (nb - 1) / 2) AS pb, sum(-nb / t * ln(nb / t)) AS hb FROM b, t)
      SELECT round((bo - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM j, x, y, t""",
    "dcl_loss": f"""WITH {_ROWS}, s AS (SELECT anchor, dp, [CASE WHEN (i - 1 + anchor) % 6 = 0 THEN -3.4028234663852886e38 ELSE -greatest(dn[i] - 0.1, 0) / 0.5 END FOR i IN range(1, len(dn) + 1)] AS s FROM r)
      SELECT round(avg(dp / 0.5 + list_max(s) + ln(list_sum([exp(e - list_max(s)) FOR e IN s]))), 6) AS loss, count(*) AS n FROM s""",
    "triplet_loss": f"""WITH {_ROWS}, e AS (SELECT dp, unnest(dn) AS dn, unnest(range(0, len(dn))) AS i FROM r), l AS (SELECT greatest((dp - dn + 0.5) / 0.8, 0) AS l, CAST(i % 3 + 1 AS DOUBLE) AS w FROM e)
      SELECT round(avg(l), 6) AS loss, round(sum(l * w) / sum(w), 6) AS weighted FROM l""",
    "level_radius_loss": f"""WITH {VECTORS}, g AS (SELECT abs(sqrt(greatest(x[1] * x[1] - 1, 1e-8)) - (label % 5) / 2.0::DOUBLE) AS g, greatest(sqrt(greatest(x[1] * x[1] - 1, 0) + 1e-8) - 0.9, 0) AS o FROM lifted)
      SELECT round(avg(CASE WHEN g < 1 THEN 0.5 * g * g ELSE g - 0.5 END), 6) AS loss, round(0.01 * avg(o * o), 6) AS penalty FROM g""",
    "hierarchy_loss": f"WITH {_ALL}, m AS (SELECT avg(d) AS md, avg(t) AS mt FROM once) SELECT round(0.325 * avg((d / md - t / mt) * (d / md - t / mt)), 6) AS loss FROM once, m",
    "rank_order_loss": f"""WITH {_ALL}, g AS (SELECT a.d - b.d + 0.1 AS g FROM both_ways a JOIN both_ways b ON a.id_i = b.id_i AND a.t < b.t)
      SELECT round(sum(g) FILTER (g > 0) / greatest(count(*) FILTER (g > 0), 1), 6) AS loss, count(*) FILTER (g > 0) AS n_active FROM g""",
    "adaptive_margin": f"""WITH {_ALL} SELECT t, round(avg(least(greatest(0.5 + 0.4 * (1 - tanh(d / 4)) + 0.2 * (1 - tanh(t / 6)), 0.4), 2.0)), 6) AS graph,
      round(avg(least(greatest(0.5 + 0.5 * least(greatest(d / 10, 0), 1) + 0.2 * (1 - t / 4), 0.5), 3.0)), 6) AS confident, count(*) AS n FROM once GROUP BY 1""",
    "phase_losses": f"""WITH {_ROWS}, e AS (SELECT anchor % 4 + 1 AS phase, dp, unnest(dn) AS dn FROM r), p AS (SELECT phase, avg(greatest(dp - dn + 1.0, 0)) AS b, avg(dn) AS a, avg(pow((dp - dn) / 2, 2)) AS k FROM e GROUP BY 1)
      SELECT phase, round(CASE WHEN phase <= 2 THEN b WHEN phase = 3 THEN b + 0.1 * a ELSE 0.5 * b + 0.5 * k END, 6) AS loss FROM p""",
    "precision_recall_at_k": f"WITH {_RANKS} {_pr(5)} UNION ALL {_pr(10)} UNION ALL {_pr(20)}",
    "map_score": f"""WITH {_RANKS}, s AS (SELECT id_i, nth, CAST(t = 0.5 AS INTEGER) AS r, sum(CAST(t = 0.5 AS INTEGER)) OVER (PARTITION BY id_i ORDER BY nth) / CAST(nth AS DOUBLE) AS p FROM ranks),
      a AS (SELECT id_i, sum(p * r) / greatest(sum(r), 1) AS ap FROM s GROUP BY 1) SELECT round(avg(ap), 6) AS map FROM a""",
    "ndcg_at_k": f"WITH {_RANKS}, {_GRADED.format('4.0::DOUBLE - t')}, n AS ({_ndcg(10)}) SELECT k, round(avg(coalesce(ndcg, 0)), 6) AS ndcg, round(min(coalesce(ndcg, 0)), 6) AS least FROM n GROUP BY k",
    "ndcg_ranking": f"""WITH {_RANKS}, {_GRADED.format('(max(t) OVER (PARTITION BY id_i) - t + 1e-6) / (max(t) OVER (PARTITION BY id_i) + 1e-6)')},
      n AS ({_ndcg(5)} UNION ALL {_ndcg(10)} UNION ALL {_ndcg(20)}) SELECT k, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM n GROUP BY k""",
    "cophenetic": f"WITH {_ALL} SELECT round(corr(d, t), 6) AS correlation, count(*) AS n_pairs FROM once",
    "spearman_ordinal": f"""WITH {_ALL}, r AS (SELECT row_number() OVER (ORDER BY round(d, 9), id_i, id_j) AS rd, row_number() OVER (ORDER BY t, id_i, id_j) AS rt FROM once)
      SELECT round(corr(rd, rt), 6) AS correlation, count(*) AS n_pairs FROM r""",
    "distortion": f"WITH {_ALL} SELECT round(avg(d / t), 6) AS mean, round(max(d / t), 6) AS max, round(min(d / t), 6) AS min, round(stddev_samp(d / t), 6) AS std, round(quantile_disc(d / t, 0.5), 6) AS median FROM once",
    "collapse_check": f"""WITH {VECTORS}, n AS (SELECT avg({_NORM}) AS nm, stddev_samp({_NORM}) AS ns FROM vec), d AS (SELECT avg(list_distance(a.v, b.v)) AS dm, stddev_samp(list_distance(a.v, b.v)) AS ds FROM vec a JOIN vec b ON a.id < b.id),
      e AS (SELECT unnest(v) AS e, unnest(range(1, 65)) AS i FROM vec), w AS (SELECT avg(q) AS vm FROM (SELECT var_samp(e) AS q FROM e GROUP BY i))
      SELECT round(nm, 6) AS norm_mean, round(ns, 6) AS norm_std, round(dm, 6) AS distance_mean, round(ds, 6) AS distance_std, round(vm, 6) AS variance_mean, round(ns / nm, 6) AS norm_cv, round(ds / dm, 6) AS distance_cv,
      vm < 0.001 AS variance_collapse, ns / nm < 0.05 AS norm_collapse, ds / dm < 0.05 AS distance_collapse FROM n, d, w""",
    "radius_structure": f"""WITH {VECTORS}, {_HEAP}, l AS (SELECT level, avg(radius) AS m, quantile_cont(radius, 0.75) AS hi, quantile_cont(radius, 0.25) AS lo FROM heap GROUP BY 1),
      g AS (SELECT lead(m) OVER w - m - greatest(hi - lead(lo) OVER w, 0) AS g FROM l WINDOW w AS (ORDER BY level)), s AS (SELECT avg(CAST(c.radius > p.radius AS DOUBLE)) AS mono, count(*) AS n FROM edges JOIN heap p ON parent = p.id JOIN heap c ON child = c.id)
      SELECT round((SELECT avg(g) FROM g), 6) + 0.0 AS separation, round(mono, 6) AS monotonicity, n AS n_edges FROM s""",
    "retrieval_parent_child_sibling": f"""WITH {_RANKS}, {_HEAP}, {_SIBS},
      c AS (SELECT parent, avg(CAST(nth <= 20 AS DOUBLE)) AS s FROM edges JOIN ranks ON id_i = parent AND id_j = child GROUP BY 1), b AS (SELECT id_i, max(CAST(nth = 1 AS DOUBLE)) AS c FROM sibs JOIN ranks USING (id_i, id_j) GROUP BY 1)
      SELECT round(avg(CAST(nth <= 5 AS DOUBLE)), 6) AS parent_retrieval, round((SELECT avg(s) FROM c), 6) AS child_retrieval, round((SELECT avg(c) FROM b), 6) AS sibling_confusion FROM edges JOIN ranks ON id_i = child AND id_j = parent""",
    "taxonomy_reconstruction": f"""WITH {_ALL}, {_HEAP}, r AS (SELECT id_i, id_j, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth FROM both_ways JOIN heap a ON a.id = id_i JOIN heap b ON b.id = id_j WHERE b.level = a.level - 1)
      SELECT count(*) AS evaluated, round(avg(CAST(nth <= 1 AS DOUBLE)), 6) AS top_1, round(avg(CAST(nth <= 3 AS DOUBLE)), 6) AS top_3, round(avg(CAST(nth <= 5 AS DOUBLE)), 6) AS top_5 FROM r JOIN edges ON id_i = child AND id_j = parent""",
    "industry_similarity": f"""WITH {_RANKS}, {_HEAP}, {_SIBS}, p AS (SELECT id_i, min(nth) AS first, count(*) FILTER (nth <= 5) AS h5, count(*) FILTER (nth <= 10) AS h10 FROM sibs JOIN ranks USING (id_i, id_j) GROUP BY 1)
      SELECT count(*) AS evaluated, round(avg(h5 / 5.0::DOUBLE), 6) AS precision_5, round(avg(h10 / 10.0::DOUBLE), 6) AS precision_10, round(avg(first), 6) AS mean_first_rank FROM p""",
    "lambdarank_loss": f"""WITH {_ALL}, e AS (SELECT id_i, id_j, d, 4.5::DOUBLE - t AS rel, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth, row_number() OVER (PARTITION BY id_i ORDER BY t) AS best FROM both_ways),
      f AS (SELECT *, CASE WHEN nth <= 10 THEN 1 / log2(nth + 1) ELSE 0 END AS disc, sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) OVER (PARTITION BY id_i) AS ideal FROM e)
      SELECT a.id_i AS anchor, round(sum(abs((a.rel - b.rel) * (a.disc - b.disc)) / a.ideal * ln(1 + exp(-(b.d - a.d)))) / count(*), 6) AS loss FROM f a JOIN f b ON a.id_i = b.id_i AND a.rel > b.rel GROUP BY 1""",
    "validation_metrics": f"""WITH {_ROWS}, f AS (SELECT unnest(list_concat([dp], dn)) AS d FROM r), m AS (SELECT stddev_samp(d) / avg(d) AS s FROM f), g AS (SELECT avg(e) AS n FROM (SELECT unnest(dn) AS e FROM r))
      SELECT round(avg(dp), 6) AS avg_positive_dist, round(avg(CAST(dp < list_min(dn) AS DOUBLE)), 6) AS relation_accuracy, round(avg(CAST(dp < list_min(dn) AS DOUBLE)), 6) AS top_k_accuracy,
      round(avg(len([e FOR e IN dn IF e < dp])), 6) AS mean_positive_rank, round(any_value(n), 6) AS avg_negative_dist, round(any_value(s), 6) AS distance_spread FROM r, m, g""",
}
SQL["total_loss"] = f"""WITH terms AS (
  SELECT 1.0::DOUBLE AS w, 0.0::DOUBLE AS s, loss FROM ({SQL['dcl_loss']}) UNION ALL SELECT 0.01, 0.1, load_balance FROM ({SQL['load_balance']}) UNION ALL SELECT 1.0, 0.2, loss FROM ({SQL['hierarchy_loss']})
  UNION ALL SELECT 0.275, 0.3, loss FROM ({SQL['rank_order_loss']}) UNION ALL SELECT 1.0, 0.4, penalty FROM ({SQL['level_radius_loss']}))
SELECT round(sum(w * loss), 5) AS total, round(sum(0.5 * exp(-s) * loss + 0.5 * s), 5) AS uncertain FROM terms"""
SQL["lorentz_curved"] = f"""WITH {VECTORS}, p AS (SELECT a.id AS id_i, b.id AS id_j, sqrt(2.0::DOUBLE) * {_D.format('a.x', 'b.x', '1.0')} AS d FROM lifted a JOIN lifted b ON a.id <> b.id)
  SELECT id_i, id_j, nth, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id_i ORDER BY d, id_j) AS nth FROM p) WHERE nth <= 3"""


def _layer_sql(n):
    """One round over t{n - 1} (id, i, e): messages are added, the norm is held at 3, and the point is mapped there and back."""
    return f"""g{n} AS MATERIALIZED (SELECT a.dst AS id, t.i, sum(a.a * t.e) AS m FROM att a JOIN t{n - 1} t ON t.id = a.src GROUP BY 1, 2),
u{n} AS MATERIALIZED (SELECT t.id, t.i, t.e + coalesce(m, 0) AS e FROM t{n - 1} t LEFT JOIN g{n} g ON g.id = t.id AND g.i = t.i),
n{n} AS MATERIALIZED (SELECT id, greatest(sqrt(sum(e * e)), 1e-8) AS n FROM u{n} GROUP BY 1),
c{n} AS MATERIALIZED (SELECT u.id, u.i, u.e * least(1, 3.0::DOUBLE / n) AS e, least(n, 3.0::DOUBLE) AS n FROM u{n} u JOIN n{n} USING (id)),
t{n} AS MATERIALIZED (SELECT id, i, sinh(n) / n * e * acosh(greatest(cosh(n), 1.00001)) / sinh(acosh(greatest(cosh(n), 1.00001))) AS e FROM c{n})"""


SQL["attention_layers"] = f"""WITH {VECTORS}, {_HEAP}, b AS (SELECT parent AS src, child AS dst, 0.0::DOUBLE AS s FROM edges UNION ALL SELECT child, parent, 0.5 FROM edges),
  att AS MATERIALIZED (SELECT src, dst, exp(s) / sum(exp(s)) OVER (PARTITION BY dst) AS a FROM b), t0 AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS i, unnest({_TANGENT}) AS e FROM lifted), {_layer_sql(1)}, {_layer_sql(2)}
  SELECT id, round(cosh(any_value(n)), 5) AS time, round(max(sinh(n) / n * e) FILTER (i = 1), 5) AS first FROM c2 GROUP BY id"""
SQL["evaluation_run"] = f"""WITH c AS ({SQL['cophenetic']}), s AS ({SQL['spearman_ordinal']}), d AS ({SQL['distortion']}), p AS ({SQL['precision_recall_at_k']}), m AS ({SQL['map_score']}),
  r AS (WITH {VECTORS} SELECT round(avg(x[1]), 6) AS mean, round(stddev_samp(x[1]), 6) AS std FROM lifted)
  SELECT 'cophenetic' AS metric, correlation AS value FROM c UNION ALL SELECT 'spearman', correlation FROM s UNION ALL SELECT 'distortion_mean', mean FROM d UNION ALL SELECT 'distortion_std', std FROM d
  UNION ALL SELECT 'radius_mean', mean FROM r UNION ALL SELECT 'radius_std', std FROM r UNION ALL SELECT 'precision_' || k, precision FROM p UNION ALL SELECT 'recall_' || k, recall FROM p UNION ALL SELECT 'map', map FROM m"""
