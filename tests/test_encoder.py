"""The fusion of channels, row by row."""

import numpy as np
import pytest

from cladeworks.operators import encoder


def model(rng, width=6, hidden=4, out=3, n=3, **more):
    experts = tuple(encoder.Expert(rng.normal(size=(hidden, width)), rng.normal(size=hidden), rng.normal(size=(width, hidden)), rng.normal(size=width)) for _ in range(n))
    return encoder.Fusion(rng.normal(size=(n, width)), rng.normal(size=n), experts, rng.normal(size=(out, width)), rng.normal(size=out), **more)


@pytest.mark.parametrize(("top_k", "c"), [(1, 1.0), (2, 2.0), (3, 0.5)])
def test_rows_are_fused_one_by_one(spark, top_k, c):
    rng = np.random.default_rng(7)
    m = model(rng, top_k=top_k, c=c)
    x = rng.normal(size=(25, 6))
    got = {r.id: r for r in encoder.fused(spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "id int, x array<double>, experts string").repartition(3), m, ["id"]).collect()}
    for i, v in enumerate(x):
        logits = m.gate @ v + m.gate_bias
        order = sorted(range(3), key=lambda e: (-logits[e], e))[:top_k]
        weight = np.exp(logits[order]) / np.exp(logits[order]).sum()
        mixed = sum(w * (m.experts[e].out @ np.maximum(m.experts[e].into @ v + m.experts[e].into_bias, 0) + m.experts[e].out_bias) for w, e in zip(weight, order))
        flat = m.projection @ mixed + m.projection_bias
        r = got[i]
        assert r.experts == order and np.allclose(r.gate_probs, np.exp(logits) / np.exp(logits).sum()) and np.allclose(r.embedding_euc, flat)
        p = np.array(r.embedding)
        assert abs(-p[0] ** 2 + (p[1:] ** 2).sum() + 1 / c) < 1e-6 * p[0] ** 2 and np.allclose(p[1:] / np.linalg.norm(p[1:]), flat / np.linalg.norm(flat))
        assert abs(np.arccosh(p[0] * np.sqrt(c)) - np.sqrt(c) * min(3.0, np.linalg.norm(flat))) < 1e-6


def test_channels_are_pooled_by_their_masks(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]], [1, 1], [[5.0]], [0]), (2, [[1.0, 2.0], [3.0, 4.0]], [0, 1], [[5.0]], [1])], "id int, a array<array<double>>, a_mask array<int>, b array<array<double>>, b_mask array<int>")
    assert {r.id: r.x for r in encoder.pooled(df, ["a", "b"]).collect()} == {1: [2.0, 3.0, 0.0], 2: [3.0, 4.0, 5.0]}


def test_models_must_fit(spark):
    rng = np.random.default_rng(1)
    m = model(rng)
    with pytest.raises(ValueError, match="top_k"):
        model(rng, top_k=4)
    with pytest.raises(ValueError, match="width"):
        encoder.Fusion(m.gate, m.gate_bias, m.experts, m.projection[:, :5], m.projection_bias)
    assert encoder.fused(spark.createDataFrame([], "id int, x array<double>"), m, ["id"]).count() == 0
