import math

import pytest
from pyspark.sql import functions as F

from cladeworks.operators import sampling as S
from cladeworks.operators import triplets as R


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(0, 1, "a", "p", 2, 0.5), (0, 2, "a", "n", 5, 2.0), (1, 2, "p", "n", 3, 1.0), (0, 3, "a", "u", 99, 99.0), (1, 3, "p", "u", 99, 99.0), (0, 2, "a", "n", 5, 2.0)]
    return spark.createDataFrame(data, "idx_i int, idx_j int, code_i string, code_j string, relation_id int, distance double")


def test_greatest_distance_is_no_positive_and_rows_are_distinct(pairs):
    assert rows(R.positives(pairs), "anchor_code", "positive_code") == [("a", "n"), ("a", "p"), ("p", "n")]
    assert R.negatives(pairs).count() == 5


def test_margins_and_overrides(spark, pairs):
    got = {r.negative_code: r for r in R.triplets(pairs).where("anchor_code = 'a' and positive_code = 'p'").collect()}
    assert got["n"].relation_margin == 3 and got["n"].distance_margin == 1.5 and not got["n"].unrelated
    assert got["u"].relation_margin == 15 and got["u"].distance_margin == 10 and got["u"].unrelated
    assert math.isclose(got["n"].margin, 1 / (0.3333 * 3 + 0.6667 * 1.5))
    case = "positive_relation int, negative_relation int, positive_distance double, negative_distance double"
    special = R.with_margins(spark.createDataFrame([(1, 2, 1.0, 1.0), (1, 2, 1.0, 0.5), (3, 0, 1.0, 0.0), (2, 1, 1.0, 3.0)], case))
    assert rows(special, "relation_margin", "distance_margin", "excluded") == [(0.1, 0.1, True), (1.0, 0.3333, False), (1.0, 0.6667, False)]


def test_cap_keeps_related_ones(spark):
    df = spark.createDataFrame([(0, 0, i, i % 2 == 0) for i in range(20)], "anchor_idx int, positive_idx int, negative_idx int, unrelated boolean")
    kept = R.cap_unrelated(df, F.col("negative_idx"), 3)
    assert rows(kept.where("unrelated"), "negative_idx") == [(0,), (2,), (4,)] and kept.where("not unrelated").count() == 10


def test_weights(spark):
    df = spark.createDataFrame([(2.0, False), (4.0, False), (None, False), (0.0, False), (3.0, True)], "d double, x boolean")
    got = [r.w for r in df.select(S.phase1_weight(F.col("d"), F.col("x"), 1.0).alias("w")).collect()]
    assert got == [0.0, 0.25, 1 / 12, 0.0, 100.0]
    buckets = spark.createDataFrame([(0, 1.0), (0, 6.0), (0, 7.0), (1, 9.0), (1, 8.0)], "g int, d double")
    w = {(r.g, r.d): r.weight for r in S.sans_weight(buckets, ["g"], F.col("d"), 4.0, 0.8, 0.2).collect()}
    assert math.isclose(w[0, 1.0], 0.8) and math.isclose(w[0, 6.0], 0.1) and math.isclose(w[1, 9.0], 0.5)


def test_weighted_sample_is_a_repeatable_subset(spark):
    df = spark.range(200).select((F.col("id") % 4).alias("g"), "id", F.when(F.col("id") % 4 == 3, 0.0).otherwise(F.when(F.col("id") % 5 == 0, 50.0).otherwise(1.0)).alias("w"))
    a = S.weighted_top(df, ["g"], "w", 6, 7, ["id"])
    b = S.weighted_top(df.repartition(7), ["g"], "w", 6, 7, ["id"])
    assert rows(a, "g", "id") == rows(b, "g", "id") and a.count() == 24
    assert rows(S.weighted_top(df, ["g"], "w", 6, 8, ["id"]), "id") != rows(a, "id")
    heavy = a.where("w = 50").count()
    assert heavy >= 9  # a fifth of the rows, most of the mass


def test_filters_and_padding(spark):
    df = spark.createDataFrame([(0, 3, True), (1, 4, False)], "anchor_idx int, anchor_level int, excluded boolean")
    assert rows(df.where(S.filters({"anchor_level": [3, 5], "excluded": True, "n": 4})), "anchor_idx") == [(0,)]
    assert df.where(S.filters({"seed": 1})).count() == 2
    lists = spark.createDataFrame([([1, 2],), ([],), ([1, 2, 3, 4],)], "n array<int>")
    assert [r.p for r in lists.select(S.padded(F.col("n"), 3).alias("p")).collect()] == [[1, 2, 2], [], [1, 2, 3]]


def test_mixed_negatives_fill_up(spark):
    ranked = spark.createDataFrame([(0, 5, 1), (0, 6, 2)], "anchor int, negative int, nth int")
    pool = spark.createDataFrame([(0, n) for n in range(5, 15)], "anchor int, negative int")
    got = S.mixed_negatives(ranked, pool, 6, 0.5, 1).collect()
    assert len(got) == 6 and sum(r.hard for r in got) == 2 and len({r.negative for r in got}) == 6


def test_split_keeps_one_row_each(spark):
    two = S.ordered_split(spark.range(2), ["id"])
    assert rows(two, "id", "split") == [(0, "train"), (1, "validation")]
    assert S.ordered_split(spark.range(100), ["id"]).where("split = 'train'").count() == 95


def odd_nodes(spark):
    codes = ["11", "111", "1111", "11111", "111111", "111112", "112", "31", "311", "32", "321", "3211", "32111", "321111", "321112", "44", "441", "45", "451", "4511", "45111", "451111"]
    return spark.createDataFrame([(i, c, len(c)) for i, c in enumerate(codes)], "index int, code string, level int")


def test_triplets_laid_out_are_those_of_three_joins(spark):
    from cladeworks.operators.pairs import pair_table

    nodes = odd_nodes(spark)
    excluded = spark.createDataFrame([("111111", ["111112", "321111"]), ("3211", ["45"])], "code string, excluded_codes array<string>")
    layout = R.Layout(nodes, excluded, 3)
    want = sorted(map(tuple, R.triplets(pair_table(nodes, excluded)).collect()))
    assert want and sorted(map(tuple, layout.triplets().collect())) == want
    counts = {(r.positive_relation, r.negative_relation): r.n for r in R.stats(layout.triplets()).collect()}
    assert sum(counts.values()) == len(want)


def test_triplets_laid_out_need_no_exchange(spark):
    plan = R.Layout(odd_nodes(spark), None, 4).triplets()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
