"""What a search for nearest neighbours ships, writes and holds, beside its results."""

import numpy as np
import pytest

from cladeworks.operators import pairwise, sampling, tiles
from cladeworks.plans import extra_plans, vector_plans
from tests.conftest import SMALL
from tests.test_tiles import frame, points


def plainly(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def watched(monkeypatch):
    """Names of what is staged, with the frames; tiles are small."""
    seen, real = [], pairwise.staged
    monkeypatch.setattr(pairwise, "staged", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    monkeypatch.setattr(tiles, "TILE_PAIRS", 500)
    monkeypatch.setattr(tiles, "STRIP_BYTES", 40 * 8 * 6)
    return seen


@pytest.mark.parametrize("metric", ["lorentz", "euclidean"])
def test_one_search_finds_both_sides(spark, watched, metric):
    v = points(metric, 150, 7)
    v[30:45] = v[30]  # ties
    df = frame(spark, v, group=[None if i % 17 == 0 else i % 3 for i in range(150)])
    got = pairwise.nearest_in_and_out(df, 2, 7, metric, "g").cache()
    assert len([x for x, _ in watched if x == "near-first"]) == 1
    for inside, k in ((True, 2), (False, 7)):
        want = pairwise.nearest(df, k, metric, apart="g", inside=inside).select("id_i", "id_j", "nth")
        assert plainly(got.where(got.inside == inside).select("id_i", "id_j", "nth")) == plainly(want)


def test_few_in_a_group(spark, watched):
    """Where there are fewer than k, all are found, however far."""
    v = points("euclidean", 90, 2)
    df = frame(spark, v, group=[i if i < 10 else 10 + i % 2 for i in range(90)])
    got = pairwise.nearest_in_and_out(df, 60, 200, "euclidean", "g")
    count = {(r.id_i, r.inside): r["count"] for r in got.groupBy("id_i", "inside").count().collect()}
    assert count == {(i, s): (39 if s else 50) if i >= 10 else 89 for i in range(90) for s in (True, False) if i >= 10 or not s}


def test_vectors_travel_in_half_the_bytes_where_nothing_is_lost(spark, watched):
    v = points("euclidean", 150, 3).astype(np.float32).astype(float)
    for first, narrow in ((np.sqrt(1 + (v * v).sum(1)), True), (np.sqrt(2) * v[:, 0], True)):
        x = np.hstack([first[:, None], v])
        watched.clear()
        got = plainly(pairwise.nearest(frame(spark, x), 4, "euclidean"))
        visits = next(df for label, df in watched if label == "near-visits")
        assert ("tail" in visits.columns) == narrow and dict(visits.dtypes).get("tail", "array<float>") == "array<float>"
        assert visits.count() == 150  # a row an id, however many strips it looks into
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        np.fill_diagonal(d, np.inf)
        assert [(i, j, n) for i, j, _, n in got] == sorted((i, int(j), n + 1) for i in range(150) for n, j in enumerate(np.lexsort((np.arange(150), d[i]))[:4]))
        assert all(value == d[i, j] for i, j, value, _ in got)
    watched.clear()
    pairwise.nearest(frame(spark, points("euclidean", 150, 3)), 4, "euclidean").count()
    assert "v" in next(df for label, df in watched if label == "near-visits").columns


def test_a_number_beside_each_pair(spark, watched):
    v = points("lorentz", 120, 9)
    got = pairwise.nearest(frame(spark, v), 5, "lorentz", beside=lambda a, b: a[:, 1] - 2 * b[:, 2]).collect()
    assert len(got) == 600 and all(abs(r.beside - (v[r.id_i, 1] - 2 * v[r.id_j, 2])) < 1e-12 for r in got)


def test_what_is_new_waits_no_longer_than_what_is_kept(monkeypatch):
    monkeypatch.setattr(pairwise, "BLOCK", 64)
    rng, n, k = np.random.default_rng(1), 3_000, 40
    held = type("A", (), {"ids": np.arange(n)})()
    best = pairwise._Best(held, np.full(n, np.inf), k, False, None)
    values, most = rng.integers(0, 50, size=(n, 600)).astype(float), 0  # many ties
    for begin in range(0, 600, 10):
        row, j = np.divmod(np.arange(n * 10), 10)
        best.add(row, 1_000 - (begin + j), values[row, begin + j])
        most = max(most, best.n_new)
    assert most <= n * k
    best.merge()
    row, ids, value = best.kept
    order = [np.lexsort((1_000 - np.arange(600), values[i]))[:k] for i in range(n)]
    assert (row == np.repeat(np.arange(n), k)).all() and (ids == 1_000 - np.concatenate(order)).all()
    assert (value == np.concatenate([values[i, o] for i, o in enumerate(order)])).all() and (best.reached == value.reshape(n, k)[:, -1]).all()


@pytest.mark.parametrize("name", ["hard_negative_sample", "blended_sample"])
def test_a_sample_searches_what_it_draws(spark, monkeypatch, name):
    asked, real = [], sampling.nearest
    monkeypatch.setattr(sampling, "nearest", lambda df, k, *a, **b: asked.append(k) or real(df, k, *a, **b))
    hard = {r.hard for r in extra_plans.QUERIES[name](spark, SMALL).where("hard").select("nth", "hard").collect()}
    assert hard == {True} and asked == [{"hard_negative_sample": 5, "blended_sample": 3}[name]]


def test_losses_of_a_row_take_one_search(spark, monkeypatch):
    asked, real = [], vector_plans.P._nearest
    monkeypatch.setattr(vector_plans.P, "_nearest", lambda df, wants, *a, **b: asked.append(wants) or real(df, wants, *a, **b))
    assert vector_plans.QUERIES["dcl_loss"](spark, SMALL).first().n == 500
    assert asked == [[(1, True), (19, False)]]


def test_cosines_come_from_the_search(spark):
    """No vector of a candidate is joined to its anchor."""
    plan = vector_plans.QUERIES["false_negative_loss"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "embedding:" not in plan
