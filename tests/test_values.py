"""Queries without SQL against plain computations over the smallest tables."""

import math
from collections import Counter

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from cladeworks import config, jobs
from cladeworks.operators import control, evaluation
from cladeworks.plans import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def lifted():
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    v = np.array(e.embedding.tolist(), float)
    return e.vec_id.to_numpy(), e.label.to_numpy(), v


def lorentz(v):
    time = np.sqrt((v * v).sum(axis=1) + 1)
    d = np.arccosh(np.maximum(np.outer(time, time) - v @ v.T, 1 + 1e-5))
    return d


def test_core_numbers_by_peeling(spark):
    s = pd.read_parquet(f"{SMALL}/supplier.parquet").sort_values("s_suppkey")
    near = {int(i): set() for i in s.s_suppkey}
    for key, following in ((s.s_nationkey, 3), (np.floor(s.s_acctbal.astype(float) / 250), 2)):
        for _, ids in s.groupby(key).s_suppkey:
            ids = [int(i) for i in ids]
            for at, i in enumerate(ids):
                for j in ids[at + 1 : at + 1 + following]:
                    near[i].add(j)
                    near[j].add(i)
    core, left, k = {}, {i: set(n) for i, n in near.items()}, 0
    while left:
        i = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[i]))
        core[i] = k
        for j in left.pop(i):
            left[j].discard(i)
    assert {r.id: r.core for r in QUERIES["kcore"](spark, SMALL).collect()} == core


def test_ridge_by_linear_algebra(spark):
    rows = QUERIES["employment_slice"](spark, SMALL).select("avg_estabs", "avg_wages", "log_avg_emp").na.drop().toPandas().to_numpy(float)
    x, y = rows[:, :2], rows[:, 2]
    n = len(y)
    # the penalty is on coefficients of inputs and label scaled to deviation 1
    sx, sy = x.std(axis=0, ddof=1), y.std(ddof=1)
    z, w = (x - x.mean(axis=0)) / sx, (y - y.mean()) / sy
    beta = np.linalg.solve(z.T @ z / n + np.eye(2) / sy, z.T @ w / n)
    e = w * sy - (z @ beta) * sy
    got = QUERIES["ridge_fit"](spark, SMALL).first()
    assert got.n == n and math.isclose(got.rmse, math.sqrt((e**2).mean()), rel_tol=2e-3) and abs(got.r2 - (1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())) < 5e-3


def test_change_of_metrics_by_hand(spark):
    ids, label, v = lifted()
    tree = np.where(label[:, None] == label[None], 0.5, np.where(label[:, None] // 2 == label[None] // 2, 2.0, 4.0))
    upper = np.triu_indices(len(ids), 1)
    new, old = (np.corrcoef(lorentz(x)[upper], tree[upper])[0, 1] for x in (v, v[:, :32]))
    got = {r.metric: r for r in QUERIES["verify_before_after"](spark, SMALL).collect()}
    assert abs(got["cophenetic"].new - new) < 1e-5 and abs(got["cophenetic"].old - old) < 1e-5
    assert got["cophenetic"].ok == (new - old >= -0.02) and set(got) == {"cophenetic", "ndcg_10", "parent_retrieval"}


def test_fitted_clusters_are_nearest_and_stable(spark):
    rows = QUERIES["kmeans_fit"](spark, SMALL).collect()
    ids, _, v = lifted()
    cluster = {r.id: r.cluster for r in rows}
    assert set(cluster) == set(ids.tolist()) and len({r.inertia for r in rows}) == 1
    # a cluster's points are nearer to each other than to the others, on the whole
    d, own = lorentz(v), np.array([cluster[i] for i in ids])
    same = own[:, None] == own[None]
    np.fill_diagonal(same, False)
    assert len(set(own)) > 1 and d[same].mean() < d[own[:, None] != own[None]].mean()


def test_suite_holds_what_its_parts_give(spark):
    got = {(r.task, r.metric): r.value for r in QUERIES["downstream_suite"](spark, SMALL).collect()}
    part = QUERIES["taxonomy_reconstruction"](spark, SMALL).first().asDict()
    assert all(abs(got["reconstruction", k] - v) < 1e-6 for k, v in part.items())
    part = QUERIES["cluster_agreement"](spark, SMALL).first().asDict()
    assert all(abs(got["clusters", k] - v) < 1e-6 for k, v in part.items())
    _, label, _ = lifted()
    assert got["classification", "n"] == sum(n // 5 for n in Counter(label.tolist()).values())
    assert 0 <= got["classification", "accuracy"] <= 1  # the labels of these vectors are random


def test_classifier_learns_what_can_be_learned(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(0, 1, 4) + 4 * np.eye(4)[i % 3]).tolist()) for i in range(300)]
    df = evaluation.stratified(spark.createDataFrame(rows, "id bigint, label int, v array<double>"), "label", "id", 0.2)
    assert df.where("test").groupBy("label").count().select("count").distinct().collect() == [(20,)]
    got = evaluation.classify(df, "v", "label", F.col("test")).first()
    assert got.accuracy > 0.9 and got.macro_f1 > 0.9 and got.n == 60
    wide, sets = evaluation.feature_sets(df.withColumn("sector", F.col("label").cast("string")), "v", "sector", ["0", "1", "2"], 4)
    y = wide.withColumn("y", F.col("label") * 2.0)
    r2 = {name: evaluation.ridge(y, columns, "y", evaluation.by_group("id"), 0.01).first().r2 for name, columns in sets.items()}
    assert r2["sector"] > 0.95 and r2["hybrid"] > 0.95 and r2["tangent"] > 0.5


def test_report_and_trends(spark):
    rows = [(0, e, 1.0 - e / 10, 1.2 - e / 10, 0.1 * e, "P1" if e < 3 else "P2", False, "STAY") for e in range(6)] + [(1, e, 1.0, 1.0, 0.5, "P1", True, "ROLLBACK") for e in range(2)]
    history = spark.createDataFrame(rows, "run bigint, epoch bigint, train_loss double, val_loss double, mrr double, phase string, plateau boolean, action string")
    got = {r.run: (r.epoch, round(r.change, 6), r.trend) for r in evaluation.trends(history, "mrr").collect()}
    assert got == {0: (5, 0.2, "improving"), 1: (1, 0.0, "stable")}
    text = evaluation.report(control.phase_summary(history.where("run = 0")))
    assert len(text.splitlines()) == 3 and "1.2000 -> 1.0000" in text
    radii = spark.createDataFrame([(1.0,), (12.0,), (30.0,)], "r double").select(evaluation.radius_advice(F.col("r")).alias("a"))
    assert [r.a for r in radii.collect()] == ["normal", "high", "unstable"]


def test_settings_go_through_files(tmp_path, capsys):
    changed = config.overridden(config.Config(), "sampling.seed=7", "loss.rank=0.5", "curriculum.two_phase=true")
    for name in ("a.yaml", "b.json"):
        config.save(changed, str(tmp_path / name))
        assert config.load(str(tmp_path / name)) == changed
    (tmp_path / "c.yaml").write_text("model:\n  top_k: 9\n")
    (tmp_path / "d.yaml").write_text("model:\n  top: 9\n")
    for name, part in (("c.yaml", "top_k"), ("d.yaml", "model.top")):
        try:
            config.load(str(tmp_path / name))
            raise AssertionError(name)
        except ValueError as e:
            assert part in str(e)
    jobs.main(["config", "sampling.seed=9", "--settings", str(tmp_path / "a.yaml")])
    assert '"seed": 9' in capsys.readouterr().out
