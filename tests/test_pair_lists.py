"""Losses and metrics of whole lists against those over pairs as rows."""

import numpy as np
import pytest
from test_pair_ranks import SMALL, pairs_of, points

from cladeworks.operators import losses, metrics, pair_lists, tiles
from cladeworks.operators import pairwise as P
from cladeworks.plans import vector_plans
from cladeworks.plans.vector_plans import _tree


@pytest.mark.parametrize("name", ["rank_order_loss", "lambdarank_loss", "map_score"])
def test_no_pair_becomes_a_row(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(P, "all_pairs", refused)
    assert vector_plans.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("copies", [False, True])
def test_lists_give_what_pairs_give(spark, monkeypatch, copies):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 400)
    monkeypatch.setattr(pair_lists, "LIST_BYTES", 600)
    vecs = points(spark, 70, 4, copies)
    pairs = pairs_of(vecs).withColumn("d", vector_plans.F.round("d", 9)).cache()
    want, got = losses.rank_order(pairs).first(), pair_lists.rank_order(vecs, _tree).first()
    assert got.n_active == want.n_active and got.loss == pytest.approx(want.loss, abs=1e-8)
    want = metrics.mean_average_precision(metrics.ranked(pairs), vector_plans.F.col("t") == 0.5).first().map
    assert pair_lists.mean_average_precision(vecs, _tree, 0.5, digits=9).first().map == pytest.approx(want, abs=1e-12)
    lists = pairs.selectExpr("id_i as anchor", "id_j", "d", "4.5 - t as rel")
    want = {r.anchor: r.loss for r in losses.lambda_rank(lists, 6).collect()}
    got = {r.anchor: r.loss for r in pair_lists.lambda_rank(vecs, _tree, lambda t: 4.5 - t, 6).collect()}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a], abs=1e-7) for a in want)


def test_tiles_go_in_rounds(spark, monkeypatch):
    """A round ships a copy of all vectors for each of its tiles, and no more than those lie on disk at once."""
    vecs, at_once, dealt = points(spark, 70, 4, False), [], tiles.dealt
    want = [pair_lists.rank_order(vecs, _tree).first(), pair_lists.mean_average_precision(vecs, _tree, 0.5).first()]
    monkeypatch.setattr(tiles, "TILE_PAIRS", 100)
    monkeypatch.setattr(pair_lists, "LIST_BYTES", 600)
    monkeypatch.setattr(pair_lists, "ROUND_TILES", 3, raising=False)

    def told(left, right, n_tiles, *order):
        at_once.append(n_tiles)
        return dealt(left, right, n_tiles, *order)

    monkeypatch.setattr(tiles, "dealt", told)
    got = [pair_lists.rank_order(vecs, _tree).first(), pair_lists.mean_average_precision(vecs, _tree, 0.5).first()]
    assert max(at_once) <= 2 * spark.sparkContext.defaultParallelism and len(at_once) > 3
    assert got[0].n_active == want[0].n_active and got[0].loss == pytest.approx(want[0].loss, abs=1e-12)
    assert got[1].map == pytest.approx(want[1].map, abs=1e-12)


def test_sums_of_logarithms_need_few_of_them(monkeypatch):
    rng, taken, log = np.random.default_rng(3), [], np.log
    for n in (0, 1, 2, 7, 1000):
        for top in (0.1, 5.0, 300.0, 800.0):
            raised, by = np.exp(rng.uniform(0, min(top, 700.0), (n, 4))), np.exp(-rng.uniform(0, 3, 4))
            monkeypatch.setattr(np, "log", lambda x: taken.append(np.size(x)) or log(x))
            got = pair_lists.log_sums(raised, by)
            monkeypatch.setattr(np, "log", log)
            assert got == pytest.approx(np.log1p(raised * by).sum(0), rel=1e-12)
    taken.clear()
    monkeypatch.setattr(np, "log", lambda x: taken.append(np.size(x)) or log(x))
    pair_lists.log_sums(np.exp(rng.uniform(0, 5, (1000, 4))), np.ones(4))
    assert sum(taken) <= 4 * 1000 / 32
    assert np.isnan(pair_lists.log_sums(np.array([[np.nan], [1.0]]), np.ones(1))).all()
