"""Queries of groups L (control), X (event windows) and of sources over the driver tables.

Telemetry: run = user_id mod 6, epoch = day since the first event; losses and the rank metric are means over the day's events.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators import control as C
from cladeworks.operators import evaluation as R
from cladeworks.operators import losses as L
from cladeworks.operators import metrics as E
from cladeworks.operators.pair_stats import PairStatistics
from cladeworks.operators.pairs import pair_table
from cladeworks.plans.binding import CUSTOMER_TAX, PAIRS, VECTORS, customer_nodes, table, vectors
from cladeworks.sources import artifacts as A
from cladeworks.streaming import windows as W


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _history(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("first"))
    day = e.crossJoin(F.broadcast(first)).withColumn("epoch", F.datediff(F.to_date("ts"), "first").cast("long"))  # one row
    rows = day.groupBy((F.col("user_id") % 6).alias("run"), "epoch").agg(
        F.avg("value").alias("v"), F.avg(F.when(F.col("event_type") == "error", F.col("value"))).alias("e"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("mrr")
    )
    decay = F.col("v") / (20.0 + F.col("epoch"))
    return rows.select("run", "epoch", F.round(F.col("e") / (25.0 + F.col("epoch")), 9).alias("train_loss"), F.round(decay, 9).alias("val_loss"), F.round("mrr", 9).alias("mrr"))


def curriculum_phase_flags(spark, sf):
    h = _history(spark, sf).select("epoch").distinct()
    p = h.withColumn("phase", C.phase_of(F.col("epoch"), 30))
    return p.withColumns(C.phase_flags(F.col("phase"))).withColumn("update_clusters", C.updates_clusters(F.col("epoch"), 30, 3))


def anneal_scalars(spark, sf):
    h = _history(spark, sf)
    progress = C.anneal(F.col("epoch"), 20, F.col("mrr"), 0.35)
    return _rounded(h.select("run", "epoch", progress.alias("progress"), C.between(2.0, 1.0, progress).alias("alpha"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), C.between(0.0, 0.5, progress))).alias("router_mix")))


def graph_schedule(spark, sf):
    h = _history(spark, sf).select("epoch").distinct()
    return _rounded(h.withColumns(C.graph_state(F.col("epoch"), 30, 5, 15, 0.1, 0.05, 0.5)))


def loss_velocity(spark, sf):
    return _rounded(C.loss_derivatives(_history(spark, sf)).select("run", "epoch", "velocity", "acceleration"))


def plateau_flags(spark, sf):
    return C.plateaus(_history(spark, sf), 4, 0.9).select("run", "epoch", "plateau")


def _phased(spark, sf):
    phase = F.concat(F.lit("P"), C.phase_of(F.col("epoch"), 30).cast("string"))
    return C.plateaus(_history(spark, sf), 4, 0.9).withColumns({"phase": phase, "action": F.when(F.col("epoch") % 11 == 10, "ROLLBACK").otherwise("STAY")})


def phase_transitions(spark, sf):
    return C.phase_transitions(_phased(spark, sf)).select("run", "epoch", "from_phase", "to_phase")


def phase_summary(spark, sf):
    return _rounded(C.phase_summary(_phased(spark, sf)))


def controller_replay(spark, sf):
    history = _history(spark, sf)
    return C.controller_replay(history, C.ControllerConfig(gap_tolerance=1.0, plateau_threshold=0.5))


def controller_phases(spark, sf):
    """The settings of every phase, with the epochs and runs that the controller spent in it."""
    spent = controller_replay(spark, sf).groupBy("phase").agg(F.count("*").alias("epochs"), F.count_distinct("run").alias("runs"))
    return C.phase_settings(spark).join(spent, "phase", "left").fillna(0, ["epochs", "runs"])


def confidence_ema(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("ord"), (F.col("value") / 20).alias("d"))
    return _rounded(L.confidence(e))


def events_tumbling(spark, sf):
    return _rounded(W.tumbling(table(spark, sf, "events"), "1 day", "event_type"), 4)


def events_sliding(spark, sf):
    return _rounded(W.sliding(table(spark, sf, "events"), "2 hours", "1 hour"), 4)


def events_session(spark, sf):
    return _rounded(W.sessions(table(spark, sf, "events"), "3 hours", "user_id").withColumnRenamed("stop", "until").drop("until"), 4)


def employment_slice(spark, sf):
    """Order lines as a wage table: year and owner from the order, codes from the part key."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", 5).otherwise(3).alias("own_code"))
    li = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(
        "year", "own_code", (F.col("l_partkey") % 97 + 950).cast("string").alias("industry_code"),
        F.when(F.col("l_linenumber") == 7, "N/A").otherwise(F.col("l_quantity").cast("string")).alias("annual_avg_emplvl"),
        F.col("l_tax").cast("string").alias("annual_avg_estabs"), F.col("l_extendedprice").cast("string").alias("tot_wages"),
    )
    return _rounded(A.employment_slice(rows, 1996, 5, 3), 5)


def ridge_fit(spark, sf):
    """Log employment from two other columns of the slice by ridge regression."""
    return R.ridge(employment_slice(spark, sf), ["avg_estabs", "avg_wages"], "log_avg_emp")


def label_classifier(spark, sf):
    """Labels from vectors by logistic regression on a hash split: accuracy and macro F1 on the rest."""
    return R.classify(vectors(spark, sf), "v", "label", F.pmod(F.xxhash64("id"), F.lit(5)) == 0)


def kmeans_euclidean(spark, sf):
    """Agreement of Euclidean k-means on tangent features with the labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from cladeworks.operators.cluster import agreement

    data = vectors(spark, sf).select("label", array_to_vector(V.space(V.log_zero(F.col("x")))).alias("features"))
    model = KMeans(k=10, seed=42).fit(data)
    return agreement(model.transform(data).select("label", F.col("prediction").alias("cluster")), "label", "cluster")


def log_metrics(spark, sf):
    """Log lines written from telemetry, read back by pattern; with a grade of the correlation."""
    h = _history(spark, sf).select("run", "epoch", (F.floor(F.col("mrr") * 10000) / 10000).alias("mrr"), (F.floor(F.col("val_loss") * 10000) / 10000).alias("val_loss"))
    lines = h.select("run", "epoch", F.posexplode(F.array(
        F.concat(F.lit("Epoch "), F.col("epoch").cast("string"), F.lit(" starts")), F.concat(F.lit("  Cophenetic correlation: "), F.format_string("%.4f", "mrr")),
        F.concat(F.lit("  val_loss: "), F.format_string("%.4f", "val_loss")), F.lit("  val_loss: 99.0"),
    )).alias("i", "line")).select("run", (F.col("epoch") * 4 + F.col("i")).alias("ord"), "line")
    got = A.parse_log(lines)
    return got.select("run", F.col("epoch").cast("long").alias("epoch"), "cophenetic", "val_loss", A.grade(F.col("cophenetic")).alias("grade"))


def wide_embeddings(spark, sf):
    """Vectors exported to wide columns and read back."""
    v = vectors(spark, sf).select("id", "x")
    back = A.to_vectors(A.to_wide(v, 65))
    return _rounded(back.select("id", V.radius(F.col("x")).alias("time"), V.norm(V.space(F.col("x"))).alias("norm")))


def epoch_record(spark, sf):
    """One row with the metrics of an epoch."""
    v = vectors(spark, sf)
    return _rounded(R.epoch_record(PairStatistics(v, "lorentz", lambda a, b: np.where(a == b, 0.5, 4.0), "x"), v))


def trend_report(spark, sf):
    """Where each run's rank metric goes over its last three epochs."""
    return _rounded(R.trends(_history(spark, sf), "mrr"))


def relation_shares(spark, sf):
    """Shares of relation families and of distance bins over the pairs of the large taxonomy."""
    p = pair_table(customer_nodes(spark, sf))
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 8)
    r, d = F.col("relation_id"), F.col("distance")
    return p.agg(
        share(r == 1).alias("child"), share(r == 2).alias("sibling"), share(r.isin(3, 4, 6)).alias("descendant"), share(r.isin(7, 10, 11, 12, 13, 14)).alias("cousin"),
        share(r == 99).alias("unrelated"), share(d <= 2).alias("near"), share((d > 2) & (d <= 4)).alias("middle"), share((d > 4) & (d < 99)).alias("far"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        curriculum_phase_flags, anneal_scalars, graph_schedule, loss_velocity, plateau_flags, phase_transitions, phase_summary, controller_replay, controller_phases,
        confidence_ema, events_tumbling, events_sliding, events_session, employment_slice, ridge_fit, label_classifier, kmeans_euclidean, log_metrics, wide_embeddings,
        epoch_record, trend_report, relation_shares,
    )
}

_HISTORY = """h AS (SELECT user_id % 6 AS run, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) AS BIGINT) AS epoch, value, event_type FROM events),
hist AS (SELECT run, epoch, round(avg(value) FILTER (event_type = 'error') / (25.0::DOUBLE + epoch), 9) AS train_loss, round(avg(value) / (20.0::DOUBLE + epoch), 9) AS val_loss,
  round(avg(CAST(event_type = 'purchase' AS DOUBLE)), 9) AS mrr FROM h GROUP BY 1, 2)"""
_PHASE = "CASE WHEN epoch <= 9 THEN 1 WHEN epoch <= 21 THEN 2 ELSE 3 END"
_PLATEAU = "count(*) OVER w >= 4 AND max(val_loss) OVER w - min(val_loss) OVER w < 0.9"
_FRAME = "WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
_PHASED = f"ph AS (SELECT *, 'P' || CAST({_PHASE} AS VARCHAR) AS phase, {_PLATEAU} AS plateau, CASE WHEN epoch % 11 = 10 THEN 'ROLLBACK' ELSE 'STAY' END AS action FROM hist {_FRAME})"
_PROGRESS = "CASE WHEN mrr >= 0.35 THEN 1.0::DOUBLE ELSE least(greatest(epoch, 0) / 20.0::DOUBLE, 1.0) END"
_TEMPERATURE = "(0.1::DOUBLE * (1 - least(epoch, 29) / 29.0::DOUBLE) + 0.05::DOUBLE * (least(epoch, 29) / 29.0::DOUBLE))"
_LIFTED_PAIRS = VECTORS + ", p AS (SELECT acosh(greatest(-(list_inner_product(a.x, b.x) - 2 * a.x[1] * b.x[1]), 1.00001)) AS d, CAST(CASE WHEN a.label = b.label THEN 0.5 ELSE 4.0 END AS DOUBLE) AS t FROM lifted a JOIN lifted b ON a.id < b.id)"

SQL = {
    "curriculum_phase_flags": f"""WITH {_HISTORY}, e AS (SELECT DISTINCT epoch, {_PHASE} AS phase FROM hist)
      SELECT epoch, phase, phase = 1 AS use_tree_distance, phase = 1 AS mask_siblings, phase >= 2 AS enable_hard_negative_mining, phase >= 2 AS enable_router_guided_sampling, phase >= 3 AS enable_clustering,
      phase >= 3 AND (epoch - 21) % 3 = 0 AS update_clusters FROM e""",
    "anneal_scalars": f"WITH {_HISTORY}, p AS (SELECT run, epoch, {_PROGRESS} AS p FROM hist) SELECT run, epoch, round(p, 6) AS progress, round(2.0::DOUBLE * (1 - p) + p, 6) AS alpha, round(0.5::DOUBLE * p, 6) AS router_mix FROM p",
    "graph_schedule": f"""WITH {_HISTORY}, e AS (SELECT DISTINCT epoch, CASE WHEN epoch < 5 THEN 'warmup' WHEN epoch < 15 THEN 'expansion' ELSE 'discrimination' END AS state, {_TEMPERATURE} AS t FROM hist)
      SELECT epoch, state, round(CASE WHEN state = 'discrimination' THEN greatest(0.045, t * 0.9) ELSE t END, 6) AS temperature, CASE WHEN state = 'warmup' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS margin_scale, state = 'discrimination' AS use_hard_negatives FROM e""",
    "loss_velocity": f"""WITH {_HISTORY}, l AS (SELECT run, epoch, val_loss, row_number() OVER w AS n, lag(val_loss, 1) OVER w AS a, lag(val_loss, 2) OVER w AS b, lag(val_loss, 3) OVER w AS c FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch))
      SELECT run, epoch, round(CASE WHEN n > 2 THEN val_loss - a ELSE 0 END, 6) AS velocity, round(CASE WHEN n > 3 THEN (a - b) - (b - c) ELSE 0 END, 6) AS acceleration FROM l""",
    "plateau_flags": f"WITH {_HISTORY} SELECT run, epoch, {_PLATEAU} AS plateau FROM hist {_FRAME}",
    "phase_transitions": f"WITH {_HISTORY}, {_PHASED}, l AS (SELECT run, epoch, lag(phase) OVER (PARTITION BY run ORDER BY epoch) AS from_phase, phase AS to_phase FROM ph) SELECT * FROM l WHERE from_phase IS DISTINCT FROM to_phase",
    "phase_summary": f"""WITH {_HISTORY}, {_PHASED}, s AS (SELECT run, phase, min(epoch) AS start_epoch, max(epoch) AS end_epoch, count(*) AS duration, arg_min(val_loss, epoch) AS i, arg_max(val_loss, epoch) AS f, min(val_loss) AS b,
        avg(val_loss - train_loss) AS g, max(val_loss - train_loss) AS mg, arg_max(mrr, epoch) AS m, count(*) FILTER (plateau) AS n_plateaus, count(*) FILTER (action = 'ROLLBACK') AS n_rollbacks FROM ph GROUP BY 1, 2)
      SELECT run, phase, start_epoch, end_epoch, duration, round(i, 6) AS initial_loss, round(f, 6) AS final_loss, round(b, 6) AS best_loss, round(CASE WHEN i > 0 THEN (i - f) / i ELSE 0 END, 6) AS improvement, round(g, 6) AS avg_gap, round(mg, 6) AS max_gap,
      round(m, 6) AS final_mrr, n_plateaus, n_rollbacks FROM s""",
    "confidence_ema": """WITH s AS (SELECT user_id AS node, list(1 - least(greatest(value / 20 / 10, 0), 1) ORDER BY event_id) AS s FROM events GROUP BY 1)
      SELECT node, round(pow(0.9::DOUBLE, len(s)) * 0.5 + list_sum([0.1::DOUBLE * pow(0.9::DOUBLE, len(s) - i) * s[i] FOR i IN range(1, len(s) + 1)]), 6) AS confidence, CAST(len(s) AS INTEGER) AS n FROM s""",
    "events_tumbling": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""",
    "events_sliding": """WITH e AS (SELECT date_trunc('hour', ts) AS h, value FROM events), w AS (SELECT h AS s, value FROM e UNION ALL SELECT h - INTERVAL 1 HOUR, value FROM e)
      SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    "events_session": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
      SELECT rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "employment_slice": """WITH r AS (SELECT CAST(l_partkey % 97 + 950 AS VARCHAR) AS c, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS q, l_tax, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F')
      SELECT c AS industry_code, round(avg(q) + 1e-6, 5) AS avg_emp, round(avg(l_tax) + 1e-6, 5) AS avg_estabs, round(avg(l_extendedprice) + 1e-6, 5) AS avg_wages, round(ln(avg(q) + 1e-6), 5) AS log_avg_emp FROM r WHERE length(c) = 3 GROUP BY 1""",
    "log_metrics": f"""WITH {_HISTORY} SELECT run, epoch, floor(mrr * 10000) / 10000 AS cophenetic, floor(val_loss * 10000) / 10000 AS val_loss, CASE WHEN floor(mrr * 10000) / 10000 >= 0.7 THEN 'excellent' WHEN floor(mrr * 10000) / 10000 >= 0.5 THEN 'good' WHEN floor(mrr * 10000) / 10000 >= 0.3 THEN 'fair' ELSE 'poor' END AS grade FROM hist""",
    "trend_report": f"""WITH {_HISTORY}, n AS (SELECT run, epoch, mrr, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS nth FROM hist WHERE mrr IS NOT NULL),
      a AS (SELECT run, max(epoch) AS epoch, max(mrr) FILTER (nth = 1) AS value, max(mrr) AS best, max(mrr) FILTER (nth = 1) - arg_max(mrr, nth) FILTER (nth <= 3) AS change FROM n GROUP BY 1)
      SELECT run, epoch, round(value, 6) AS value, round(best, 6) AS best, round(change, 6) AS change, CASE WHEN change > 0.01 THEN 'improving' WHEN change < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM a""",
    "wide_embeddings": f"WITH {VECTORS} SELECT id, round(x[1], 6) AS time, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM lifted",
    "epoch_record": f"""WITH {_LIFTED_PAIRS}, r AS (SELECT avg(x[1]) AS m, stddev_samp(x[1]) AS s FROM lifted) SELECT round(corr(d, t), 6) AS cophenetic, count(*) AS n_pairs, round(avg(d / t), 6) AS distortion_mean, round(stddev_samp(d / t), 6) AS distortion_std,
      round(any_value(m), 6) AS radius_mean, round(any_value(s), 6) AS radius_std FROM p, r""",
    "relation_shares": f"""WITH {CUSTOMER_TAX}, {PAIRS} SELECT round(avg(CAST(relation_id = 1 AS DOUBLE)), 8) AS child, round(avg(CAST(relation_id = 2 AS DOUBLE)), 8) AS sibling, round(avg(CAST(relation_id IN (3, 4, 6) AS DOUBLE)), 8) AS descendant,
      round(avg(CAST(relation_id IN (7, 10, 11, 12, 13, 14) AS DOUBLE)), 8) AS cousin, round(avg(CAST(relation_id = 99 AS DOUBLE)), 8) AS unrelated, round(avg(CAST(distance <= 2 AS DOUBLE)), 8) AS near,
      round(avg(CAST(distance > 2 AND distance <= 4 AS DOUBLE)), 8) AS middle, round(avg(CAST(distance > 4 AND distance < 99 AS DOUBLE)), 8) AS far FROM pairs""",
}
