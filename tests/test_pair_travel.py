"""Vectors of pair tiles travel in half the bytes where nothing is lost."""

import numpy as np
import pytest

from cladeworks.operators import pairwise as P
from cladeworks.operators import tiles


@pytest.mark.parametrize("stored", [True, False])
def test_pair_tiles_travel_in_single_precision(spark, monkeypatch, stored):
    monkeypatch.setattr(tiles, "TILE_PAIRS", 100)
    v = np.random.default_rng(1).normal(0, 1, (30, 5))
    v = v.astype(np.float32).astype(float) if stored else v
    x = np.hstack([np.sqrt(1 + (v * v).sum(1))[:, None], v])
    df = spark.createDataFrame([(i, list(map(float, a)), list(map(float, b))) for i, (a, b) in enumerate(zip(v, x))], "id bigint, v array<double>, x array<double>")
    for vector, metric, of in (("v", "cosine", v), ("v", "euclidean", v), ("x", "lorentz", x)):
        assert ("tail" in P.pair_tiles(df, vector, False).columns) == stored
        want = P.distances(of, of, metric)
        got = {(r.id_i, r.id_j): r.value for r in P.all_pairs(df, metric, vector).collect()}
        assert len(got) == 30 * 29 // 2 and all(abs(got[i, j] - want[i, j]) < 1e-12 for i, j in got)
