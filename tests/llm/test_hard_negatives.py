"""Operator 12 against SQL and a plain search."""

import numpy as np
import pytest

from cladeworks.llm import hard_negatives, queries

ROWS = "vec_id bigint, embedding array<double>, label int, id string, score string"
LARGER = "/root/testdata/sf0.1"


def test_agrees_with_sql(same_rows):
    same_rows(queries.queries()["op12_hard_negatives"], queries.oracle_sql()["op12_hard_negatives"])


def plain(rows, n_positives, n_negatives, window, anchors_every, relabel=None):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * x)) for x in v]
        kept[i] = min(kept.get(i, (lab, q)), (lab, q))
    if relabel:
        kept = {i: ((lab + 1) % 10 if i % relabel == 0 else lab, q) for i, (lab, q) in kept.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (lab, q) in kept.items():
        if a % anchors_every:
            continue
        scored = sorted((-dot(q, r), i, m) for i, (m, r) in kept.items() if i != a)
        for p, s in [(i, -s) for s, i, m in scored if m == lab][:n_positives]:
            fit = [(i, -t) for t, i, m in scored if m != lab and window[0] * s <= 100 * -t <= window[1] * s][:n_negatives]
            out += [(a, p, nth + 1, i, s, t) for nth, (i, t) in enumerate(fit)]
    return sorted(out)


def odd_rows(n=400, width=6, spread=0.05):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, width))
    rows = [(int(i), [float(x) for x in np.round(centres[i % 5] + rng.normal(size=width) * spread, 2)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [rows[0]] * 3 + [(5, rows[7][1], 9), (5, rows[8][1], 0), (None, rows[1][1], 1), (10, None, 1), (20, rows[2][1], None), (30, [None] * width, 1), (40, [float("nan")] * width, 1)]
    rows += [(1000 + i, [0.0] * width, i % 2) for i in range(30)] + [(2000, [], 1), (2010, [0.5], 0), (2020, [-x for x in rows[3][1]], 2)]
    # a third of all rows are alike
    return rows + [(3000 + i, rows[4][1], i % 2) for i in range(200)]


def result(found):
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("strip_rows", "lists", "every", "window"), [(32_768, 2000, 10, (30, 90)), (50, 40, 5, (30, 90)), (20, 100, 10, (-50, 100)), (64, 30, 1, (99, 100))])
def test_agrees_with_a_plain_search(spark, monkeypatch, strip_rows, lists, every, window):
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", lists)
    monkeypatch.setattr(hard_negatives, "BLOCK_QUERIES", 30)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(4)
    found = hard_negatives.mine(df, anchors_every=every, window=window, relabel_every=7, strip_rows=strip_rows)
    assert result(found) == plain(rows, 5, 10, window, every, 7)


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, "", ""), (2, [0.5], None, "", "")], [(100, [0.5], 1, "", "")]):
        assert hard_negatives.mine(spark.createDataFrame(rows, ROWS)).count() == 0


def test_bounds_leave_strips_out(spark, monkeypatch):
    """Vectors far apart: a query visits few of the strips, and finds what it would find in all of them."""
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 4 + rng.normal(size=8) * 0.01], i % 8, "", "") for i in range(1600)]
    index = hard_negatives.build(hard_negatives.prepared(spark.createDataFrame(rows, ROWS)), strip_rows=100)
    n_strips = index.rows.select("strip").distinct().count()
    seen = []
    real = hard_negatives.cut
    monkeypatch.setattr(hard_negatives, "cut", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    from pyspark.sql import functions as F

    every = F.array(F.struct(F.lit(-(1 << 60)).alias("low"), F.lit(1 << 60).alias("high")))
    queries_ = index.rows.where("id % 100 = 0").select(F.col("id").alias("query"), "label", "q").withColumn("windows", every)
    found = hard_negatives.search(index, queries_, 5, True)
    got = sorted((r["query"], r["rank"], r["id"]) for r in found.collect())
    q = {i: np.floor(256 * np.array(v)) for i, v, *_ in rows}
    want = [(a, nth + 1, i) for a in range(0, 1600, 100) for nth, (_, i) in enumerate(sorted((-q[a] @ q[i], i) for i in range(1600) if i != a and i % 8 == a % 8)[:5])]
    assert got == sorted(want)
    visits = sum(df.count() for label, df in seen if label.endswith("visits"))
    assert visits < 16 * n_strips / 2


def test_scores_are_exact_beyond_floating_point():
    a, b = np.array([[(1 << 29) + 1, 3]]), np.array([[(1 << 29) - 1, 5]])
    assert hard_negatives.scores(a, b)[0, 0] == ((1 << 29) + 1) * ((1 << 29) - 1) + 15
    with pytest.raises(OverflowError):
        hard_negatives.scores(a * 4, b * 4)
