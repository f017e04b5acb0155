"""Rankings of all vectors against plain computations, and queries that make no pair a row."""

from collections import defaultdict

import numpy as np
import pytest

from cladeworks.operators import metrics, pair_ranks, tiles
from cladeworks.operators import pairwise as P
from cladeworks.plans import vector_plans
from cladeworks.plans.vector_plans import _tree

SMALL = "/root/testdata/sf0.001"
NEEDLESS = "precision_recall_at_k ndcg_at_k ndcg_ranking retrieval_parent_child_sibling taxonomy_reconstruction industry_similarity downstream_suite verify_before_after".split()


def points(spark, n, seed, copies=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, 3))
    if copies:
        v[n // 2 :: 3] = v[0]
    rows = [(i * 3, None if i % 11 == 0 else i % 5, [float(np.sqrt(1 + x @ x)), *map(float, x)]) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id bigint, label int, x array<double>")


def pairs_of(vecs):
    return P.all_pairs(vecs, "lorentz", "x", True, label="label", tree=_tree).withColumnRenamed("value", "d")


@pytest.mark.parametrize("name", NEEDLESS)
def test_no_pair_becomes_a_row(spark, monkeypatch, name):
    def refused(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(P, "all_pairs", refused)
    assert vector_plans.QUERIES[name](spark, SMALL).count() > 0


def test_places_of_pairs_are_those_of_whole_rankings(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 400)  # several tiles
    vecs = points(spark, 60, 1)
    want = {(r.id_i, r.id_j): r.nth for r in metrics.ranked(pairs_of(vecs)).collect()}
    got = {(r.id_i, r.id_j): r.nth for r in pair_ranks.places(vecs, spark.createDataFrame(list(want), "id_i bigint, id_j bigint")).collect()}
    assert len(got) == 60 * 59
    ids, x = zip(*[(r.id, np.array(r.x)) for r in vecs.collect()])
    near = {a: sorted((float(np.arccosh(max(p[0] * q[0] - p[1:] @ q[1:], 1 + 1e-5))).__round__(11), b) for b, q in zip(ids, x) if b != a) for a, p in zip(ids, x)}
    assert got == {(a, b): nth for a, others in near.items() for nth, (_, b) in enumerate(others, 1)}


def test_places_among_a_group(spark):
    vecs = points(spark, 60, 2, copies=False).selectExpr("id", "x", "id % 4 as level", "id % 4 - 1 as above")
    full = metrics.ranked(P.all_pairs(vecs, "lorentz", "x", True).withColumnRenamed("value", "d").where("id_j % 4 = id_i % 4 - 1"))
    want = {(r.id_i, r.id_j): r.nth for r in full.collect()}
    got = pair_ranks.places(vecs, spark.createDataFrame(list(want), "id_i bigint, id_j bigint"), group="level", among="above").collect()
    assert {(r.id_i, r.id_j): r.nth for r in got} == want


def test_ndcg_by_counts_of_labels(spark):
    vecs = points(spark, 50, 3, copies=False)
    want = {r.k: (r.ndcg, r.n_queries) for r in metrics.ndcg_ranking(pairs_of(vecs)).collect()}
    got = {r.k: (r.ndcg, r.n_queries) for r in pair_ranks.ndcg_ranking(vecs, _tree).collect()}
    assert got.keys() == want.keys() == {5, 10, 20} and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert pair_ranks.ndcg_ranking(vecs.where("id < 60"), _tree).count() == 0  # not enough others


@pytest.mark.parametrize("copies", [False, True])
def test_places_from_blocks_of_sorted_products(spark, monkeypatch, copies):
    monkeypatch.setattr(pair_ranks, "SIDE", 7)  # products are sorted in blocks of some rows and columns
    monkeypatch.setattr(pair_ranks, "PIECE", 50)
    vecs = points(spark, 40, 6, copies)
    want = {(r.id_i, r.id_j): r.nth for r in metrics.ranked(pairs_of(vecs).withColumn("d", vector_plans.F.round("d", 12))).collect()}
    got = {(r.id_i, r.id_j): r.nth for r in pair_ranks.places(vecs, spark.createDataFrame(list(want), "id_i bigint, id_j bigint")).collect()}
    assert got == want
