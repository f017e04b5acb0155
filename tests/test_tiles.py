"""Tiles, nearest neighbours and all pairs against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeworks.operators import pairwise, tiles


def plain(a, b, metric, c=1.0, least=1 + 1e-5):
    if metric == "lorentz":
        return np.arccosh(np.maximum(2 * np.outer(a[:, 0], b[:, 0]) - a @ b.T, least)) * np.sqrt(c)
    if metric == "euclidean":
        return np.linalg.norm(a[:, None] - b[None], axis=2)
    if metric == "dot":
        return a @ b.T
    if metric == "divergence":
        p, q = [(x + 1e-8) / (x + 1e-8).sum(1, keepdims=True) for x in (a, b)]
        return (p[:, None] * np.log(p[:, None] / q[None])).sum(2)
    same = (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return same if metric == "cosine_similarity" else 1 - same


def points(metric, n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5)) * 3
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 5)) * 0.2
    if metric == "lorentz":
        v = np.hstack([np.sqrt(1 + (v * v).sum(1))[:, None], v])
    if metric == "divergence":
        v = np.exp(v) / np.exp(v).sum(1, keepdims=True)
    return v


def frame(spark, v, first=0, group=None):
    return spark.createDataFrame([(first + i, x.tolist(), None if group is None else group[i]) for i, x in enumerate(v)], "id bigint, v array<double>, g int").repartition(3)


def expected(d, ids_a, ids_b, k, largest, allowed):
    out = []
    for i, a in enumerate(ids_a):
        order = sorted((-d[i, j] if largest else d[i, j], b, d[i, j]) for j, b in enumerate(ids_b) if a != b and allowed(i, j))
        out += [(a, b, nth + 1) for nth, (_, b, _) in enumerate(order[:k])]
    return sorted(out)


@pytest.mark.parametrize("metric", pairwise.METRICS)
@pytest.mark.parametrize("pairs", [1 << 26, 800])
def test_nearest_of_one_table(spark, monkeypatch, metric, pairs):
    monkeypatch.setattr(tiles, "TILE_PAIRS", pairs)
    v = points(metric, 150, 3)
    v[40:60] = v[40]  # ties
    largest = metric in ("dot", "cosine_similarity")
    got = pairwise.nearest(frame(spark, v), 7, metric, largest=largest, c=2.0).collect()
    want = np.round(plain(v, v, metric, 2.0), 9)
    tied = lambda x: sorted((r.id_i, round(abs(r.value), 6)) for r in x)
    ids = range(150)
    best = expected(want, ids, ids, 7, largest, lambda i, j: True)
    assert tied(got) == sorted((a, round(abs(plain(v[[a]], v[[b]], metric, 2.0)[0, 0]), 6)) for a, b, _ in best)
    if metric in ("euclidean", "lorentz"):  # exact ties go by id
        assert sorted((r.id_i, r.id_j, r.nth) for r in got) == best


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("metric", ["euclidean", "lorentz", "divergence"])
def test_nearest_among_groups_of_two_tables(spark, monkeypatch, inside, metric):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 500)
    monkeypatch.setattr(tiles, "STRIP_BYTES", 40 * 8 * 6)
    a, b = points(metric, 90, 5), points(metric, 140, 6)
    ga, gb = [None if i % 17 == 0 else i % 3 for i in range(90)], [None if i % 13 == 0 else i % 4 for i in range(140)]
    got = pairwise.nearest(frame(spark, a, 0, ga), 9, metric, others=frame(spark, b, 60, gb), apart="g", inside=inside)
    together = lambda i, j: ga[i] is not None and ga[i] == gb[j]
    want = expected(np.round(plain(a, b, metric), 9), range(90), range(60, 200), 9, False, lambda i, j: together(i, j) == inside)
    assert sorted((r.id_i, r.id_j, r.nth) for r in got.collect()) == want


def test_far_cells_are_left_out(spark, monkeypatch):
    """Cells far apart: the second pass ships next to nothing."""
    monkeypatch.setattr(tiles, "STRIP_BYTES", 50 * 8 * 6)
    rng = np.random.default_rng(1)
    v = np.repeat(np.eye(6) * 100, 40, axis=0) + rng.normal(size=(240, 6))
    staged = []
    real = pairwise.staged
    monkeypatch.setattr(pairwise, "staged", lambda df, label: staged.append((label, real(df, label))) or staged[-1][1])
    got = pairwise.nearest(frame(spark, v), 5, "euclidean")
    want = expected(plain(v, v, "euclidean"), range(240), range(240), 5, False, lambda i, j: True)
    assert sorted((r.id_i, r.id_j, r.nth) for r in got.collect()) == want
    visits = next(df for label, df in staged if label == "near-visits")
    strips = next(df for label, df in staged if label == "near-right-placed").select("strip").distinct().count()
    assert strips >= 3 and visits.count() < 240 * (strips - 1) / 4


def test_vectors_off_the_hyperboloid_have_no_bounds(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 500)
    v = points("euclidean", 80, 8)
    got = pairwise.nearest(frame(spark, v), 4, "lorentz")
    want = expected(np.round(plain(v, v, "lorentz"), 9), range(80), range(80), 4, False, lambda i, j: True)
    assert sorted((r.id_i, r.id_j, r.nth) for r in got.where(F.col("value") > 0.01).collect()) == [w for w in want if plain(v[[w[0]]], v[[w[1]]], "lorentz")[0, 0] > 0.01]


@pytest.mark.parametrize("both", [False, True])
def test_all_pairs(spark, monkeypatch, both):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 300)
    monkeypatch.setattr(pairwise, "PIECE", 64)
    for metric in ("cosine", "lorentz", "euclidean"):
        v = points(metric, 60, 4)
        got = {(r.id_i, r.id_j): r.value for r in pairwise.all_pairs(frame(spark, v), metric, both_ways=both).collect()}
        want = plain(v, v, metric)
        assert sorted(got) == [(i, j) for i in range(60) for j in range(60) if (i != j if both else i < j)]
        assert all(abs(x - want[i, j]) < 1e-6 for (i, j), x in got.items())


def test_no_rows_and_few(spark):
    empty = spark.createDataFrame([], "id bigint, v array<double>")
    one = spark.createDataFrame([(1, [0.5, 0.5])], "id bigint, v array<double>")
    for df in (empty, one):
        assert pairwise.nearest(df, 3, "euclidean").count() == 0 and pairwise.all_pairs(df, "cosine").count() == 0
    assert pairwise.nearest(one, 3, "euclidean", others=empty).count() == 0 and pairwise.nearest(empty, 3, "euclidean", others=one).count() == 0


def test_strips_travel_by_the_root_of_the_tiles():
    for n, tasks in ((10**6, 100), (10**7, 400), (51_282, 12)):
        g, h = tiles.strips(n, n, 64, tasks)
        assert g * h <= 4 * max(tasks, (n * 64 * 8 / tiles.STRIP_BYTES + 1) ** 2) and abs(g - h) <= 1
    assert tiles.strips(2000, 2000, 64, 8) == (1, 1) and tiles.strips(0, 5, 3, 8) == (1, 1)
