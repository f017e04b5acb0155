"""What a task of a search holds besides its strip."""

import tracemalloc

import numpy as np
import pyarrow as pa

from cladeworks.operators import pairwise

NAMES = ["tile", "id", "v", "apart", "reached", "side"]


def batch(n, first, side):
    rng = np.random.default_rng(side)
    v = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * 64, pa.array(rng.normal(size=n * 64)))
    reached = pa.array([[None]] * n if side == 0 else [None] * n, pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n) + first), v, pa.array(rng.integers(0, 10, n)), reached, pa.array(np.full(n, side, np.int32))], NAMES)


def test_a_strip_is_held_once_and_exact_values_are_made_in_small_blocks():
    batches = [batch(20_000, 0, 0), batch(1_000, 10**6, 1)]
    tracemalloc.start()
    found = sum(b.num_rows for b in pairwise._search(batches, [(5, False)], "euclidean", False, 1.0, 1.0, None))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    # the strip's vectors are 10 MB, half of it in single precision, a piece of products and what is made of it 60 MB
    assert found == 100_000 and peak < 130, peak
