import pytest
from pyspark.sql import functions as F

from cladeworks.operators import pairs as P
from cladeworks.operators import taxonomy as T


@pytest.fixture(scope="module")
def nodes(spark):
    leaves = spark.createDataFrame([("311111",), ("321111",), ("441111",), ("311112",)], "code string")
    return T.nodes_from_leaves(leaves).cache()


def test_sectors_are_merged_at_the_root(spark):
    df = spark.createDataFrame([(c,) for c in ("31", "32", "33", "44", "45", "48", "49", "11")], "c string")
    assert [r.s for r in df.select(T.merged_sector(F.col("c")).alias("s")).collect()] == ["31", "31", "31", "44", "44", "48", "48", "11"]


def test_parent_child_distance_is_a_half(nodes):
    table = P.pair_table(nodes)
    child = {(r.code_i, r.code_j): r.distance for r in table.where("relation = 'child'").collect()}
    assert child and set(child.values()) == {0.5}
    assert ("31", "311") in child and ("31", "321") in child


def test_relations_by_steps(nodes):
    got = {(r.code_i, r.code_j): r.relation for r in P.pair_table(nodes).collect()}
    assert got["311111", "311112"] == "sibling"
    assert got["311", "321"] == "sibling" and got["321", "311"] == "unrelated"
    assert got["311111", "321111"] == "third_cousin"
    assert got["311", "441111"] == "unrelated"


def test_last_row_of_a_cell_wins_or_the_least(nodes):
    table = P.pair_table(nodes)
    ids = {r.code: r["index"] for r in nodes.collect()}
    for semantics, want in (("reference", 99.0), ("min", 2.0)):
        cells = P.matrix(table, "distance", semantics)
        cell = cells.where((F.col("row") == ids["311"]) & (F.col("col") == ids["321"])).first()
        assert cell.value == want
    with pytest.raises(ValueError):
        P.matrix(table, "distance", "max")


def test_exclusions_override_one_direction(spark, nodes):
    excluded = spark.createDataFrame([("311111", ["321111", "999999", None])], "code string, excluded_codes array<string>")
    assert [tuple(r) for r in P.exclusion_pairs(nodes, excluded).collect()] == [("311111", "321111")]
    got = {(r.code_i, r.code_j): (r.distance, r.relation_id) for r in P.pair_table(nodes, excluded).collect()}
    assert got["311111", "321111"] == (0.0, 0) and got["321111", "311111"] == (99.0, 99)


def test_first_parent_wins_and_siblings_exclude_self(spark):
    pairs = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "y", 3)], "parent string, child string, ord int")
    assert sorted(tuple(r) for r in T.siblings(pairs).collect()) == [("a", "x", "y"), ("a", "y", "x")]


def test_linear_skip_goes_to_the_first_wide_level(spark):
    leaves = spark.createDataFrame([("111111",), ("111112",), ("112111",)], "code string")
    nodes = T.nodes_from_leaves(leaves)
    got = {}
    for r in T.linear_skip(nodes, nodes.select("level", F.col("code").alias("anchor"))).collect():
        got.setdefault(r.anchor, set()).add(r.descendant)
    assert got["11"] == {"111", "112"} and got["111"] == {"111111", "111112"} and got["1121"] == {"112111"}
