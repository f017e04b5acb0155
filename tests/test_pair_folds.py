"""Sums over all pairs that tiles make against those over pairs as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pair_ranks import SMALL, pairs_of, points

from cladeworks.operators import losses, pair_folds, pair_stats
from cladeworks.operators import pairwise as P
from cladeworks.plans import vector_plans
from cladeworks.plans.vector_plans import _tree


@pytest.mark.parametrize("name", ["similarity_hist", "adaptive_margin", "hierarchy_loss", "total_loss"])
def test_no_pair_becomes_a_row(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(P, "all_pairs", refused)
    assert vector_plans.QUERIES[name](spark, SMALL).count() > 0


def test_folds_give_what_pairs_give(spark):
    vecs = points(spark, 60, 6)
    pairs = pairs_of(vecs).where("id_i < id_j").cache()
    want = {r.t: (r.n, r.s) for r in pairs.groupBy("t").agg(F.count("*").alias("n"), F.sum("d").alias("s")).collect()}
    got = {r.t: (r.n, r.s[0]) for r in pair_folds.by_tree(vecs, "lorentz", _tree, lambda d, t: [d], 1).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    bins = {r.bin: r.n for r in pairs.groupBy(F.round(F.col("d") * 5).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()}
    assert {r.bin: r.n for r in pair_folds.histogram(vecs, "lorentz", lambda x: np.floor(x * 5 + 0.5), "x").collect()} == bins
    loss = pair_stats.PairStatistics(vecs, "lorentz", _tree, "x").hierarchy_preservation(0.3).first().loss
    assert loss == pytest.approx(losses.hierarchy_preservation(pairs, 0.3).first().loss)
