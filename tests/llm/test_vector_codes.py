"""Operator 13 against SQL, a plain search and a plain fit."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cladeworks.llm import queries, vector_codes

ROWS = "vec_id bigint, embedding array<double>, label int, id string, code string"


def test_agrees_with_sql(same_rows):
    same_rows(queries.queries()["op13_vector_codes"], queries.oracle_sql()["op13_vector_codes"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.integers(1, 4), st.integers(1, 6), st.randoms())
def test_tree_finds_the_lowest_of_the_nearest(n, width, spread, rng):
    points = np.array([[rng.randint(-spread, spread) for _ in range(width)] for _ in range(n)], dtype=np.int64)
    x = np.array([[rng.randint(-2 * spread, 2 * spread) for _ in range(width)] for _ in range(50)], dtype=np.int64)
    d = ((x[:, None, :] - points[None, :, :]) ** 2).sum(2)
    at, best = vector_codes.nearest(vector_codes.kd_tree(points), x)
    assert (best == d.min(1)).all() and (at == d.argmin(1)).all()


def plain(rows, parts, entries, rounds, scale=1024):
    kept = [(i, lab, [int(np.floor(x * scale)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(q) for _, _, q in kept), default=0) // parts)) * parts
    q = np.array([k[2] + [0] * (width - len(k[2])) for k in kept], dtype=object).reshape(-1, width)
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2], kept[r][1] is None, kept[r][1] or 0))[:entries]
    own = width // parts
    cut = [q[:, p * own : (p + 1) * own] for p in range(parts)]
    books = [c[order].copy() for c in cut]

    def near(p):
        out = []
        for x in cut[p]:
            d = [int(((x - e) ** 2).sum()) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            at = [a for a, _ in near(p)]
            for e in set(at):
                mine = [cut[p][r] for r in range(len(at)) if at[r] == e]
                books[p][e] = np.array([sum(c) // len(mine) for c in zip(*mine)], dtype=object)
    found = [near(p) for p in range(parts)]
    codes = ["".join(f"{found[p][r][0]:02x}" for p in range(parts)) for r in range(len(kept))]
    errors = [sum(found[p][r][1] for p in range(parts)) for r in range(len(kept))]
    per = {}
    for (_, lab, _), e in zip(kept, errors):
        per[lab] = per.get(lab, 0) + e
    return [(k[0], k[1], c, e, per[k[1]]) for k, c, e in zip(kept, codes, errors)], books


def odd_rows(n=150):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=10) * 0.2], None if i % 11 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [rows[0]] * 4 + [(3, [0.5] * 10, 1), (None, [0.25] * 10, 2), (None, None, 2), (900, None, 0), (901, [0.1] * 9 + [None], 0), (902, [float("nan")] * 10, 0), (903, [float("inf")] * 10, 0)]
    return rows + [(904, [], 1), (905, [0.1, 0.2], 1), (906, [-0.0005] * 10, None)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 20, 3), (4, 256, 2), (1, 7, 4), (3, 5, 0)])
def test_agrees_with_a_plain_fit(spark, parts, entries, rounds):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS).repartition(3)
    coded, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, plain_books = plain(rows, parts, entries, rounds)
    assert sorted(map(tuple, coded.select("vec_id", "label", "code", "error", "label_error").collect()), key=str) == sorted(want, key=str)
    assert all((a == b).all() for a, b in zip(books, plain_books))
    text = ",".join(str(x) for b in plain_books for x in b.ravel())
    assert vector_codes.codebooks_digest(books) == hashlib.sha256(text.encode()).hexdigest()
    if parts == 1:  # the code's own vector has the error that was told
        back = coded.join(df.dropDuplicates(["vec_id"]).select("vec_id", "embedding"), "vec_id").where(F.size("embedding") == 10)
        gaps = back.select("error", F.aggregate(F.zip_with(vector_codes.decoded(F.col("code"), books), vector_codes.whole_numbers(F.col("embedding"), 1024), lambda a, b: (a - b) * (a - b)), F.lit(0), lambda s, x: s + x).alias("e"), "vec_id")
        assert gaps.where("error <> e and vec_id <> 3").count() == 0


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, "", "")]):
        coded, books = vector_codes.compress(spark.createDataFrame(rows, ROWS))
        assert coded.count() == 0 and sum(b.size for b in books) == 0


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="must be below"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1, "", "")], ROWS))
