"""All pairs of a taxonomy: tree relation, tree distance, exclusions, matrices, statistics.

Relation and distance follow from the level of the deepest common ancestor, which is a common prefix,
so the tree is never walked. Pairs come from two equi-joins, inside a raw two-digit prefix and across
prefixes, not from a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeworks.operators.taxonomy import sector_of

UNMATCHED = 99
# The relation of a pair by the steps from each side up to the deepest common ancestor.
RELATIONS = {
    (0, 1): (1, "child"),
    (1, 1): (2, "sibling"),
    (0, 2): (3, "grandchild"),
    (0, 3): (4, "great-grandchild"),
    (1, 2): (5, "nephew/niece"),
    (0, 4): (6, "great-great-grandchild"),
    (2, 2): (7, "cousin"),
    (1, 3): (8, "grand-nephew/niece"),
    (1, 4): (9, "grand-grand-nephew/niece"),
    (2, 3): (10, "cousin_1_times_removed"),
    (3, 3): (11, "second_cousin"),
    (2, 4): (12, "cousin_2_times_removed"),
    (3, 4): (13, "second_cousin_1_times_removed"),
    (4, 4): (14, "third_cousin"),
}


def kept(level_i: Column, code_i: Column, level_j: Column, code_j: Column) -> Column:
    """Whether kept_pairs() has the pair, told from its two nodes."""
    return (level_i <= level_j) & ((F.substring(code_i, 1, 2) != F.substring(code_j, 1, 2)) | (code_i < code_j))


def kept_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs in which the first is not the deeper: ordered inside a raw prefix, both ways across prefixes.

    A node table is small and its pairs are many, so the first side is spread over all partitions.
    """
    side = nodes.withColumn("raw", F.substring("code", 1, 2))
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i = side.repartition(width, "index").select(*[F.col(c).alias(f"{n}_i") for c, n in (("index", "idx"), ("code", "code"), ("level", "level"), ("raw", "raw"))])
    j = side.select(*[F.col(c).alias(f"{n}_j") for c, n in (("index", "idx"), ("code", "code"), ("level", "level"), ("raw", "raw"))])
    inside = i.join(j, (F.col("raw_i") == F.col("raw_j")) & (F.col("level_i") <= F.col("level_j")) & (F.col("code_i") < F.col("code_j")))
    # at most 90 prefixes: a row per node and other prefix keeps this an equi-join
    prefixes = side.agg(F.collect_set("raw").alias("all"))
    spread = i.crossJoin(prefixes).withColumn("other", F.explode(F.array_remove("all", F.col("raw_i")))).drop("all")
    across = spread.join(j, (F.col("other") == F.col("raw_j")) & (F.col("level_i") <= F.col("level_j"))).drop("other")
    return inside.unionByName(across)


def common_level(code_i: Column, code_j: Column) -> Column:
    """Level of the deepest common ancestor: null under different roots, 2 under different raw prefixes."""
    same = [
        F.when((F.substring(code_i, 1, n) == F.substring(code_j, 1, n)) & (F.length(code_i) >= n) & (F.length(code_j) >= n), 1).otherwise(0)
        for n in (3, 4, 5, 6)
    ]
    return F.when(sector_of(code_i) != sector_of(code_j), F.lit(None)).when(
        F.substring(code_i, 1, 2) != F.substring(code_j, 1, 2), F.lit(2)
    ).otherwise(F.lit(2) + same[0] + same[1] + same[2] + same[3])


def _steps(pairs: DataFrame) -> DataFrame:
    """Add a and b, the steps up to the common ancestor; null where the pair table has no such row."""
    in_order = F.col("code_i").cast("int") < F.col("code_j").cast("int")
    lca = F.when(in_order, common_level(F.col("code_i"), F.col("code_j")))
    with_lca = pairs.withColumn("lca", lca)
    return with_lca.withColumns({"a": F.col("level_i") - F.col("lca"), "b": F.col("level_j") - F.col("lca")})


def distance_of_steps(a: Column, b: Column) -> Column:
    """Steps in all, half a step less along one line of descent; 99 for unmatched pairs."""
    return F.coalesce((a + b).cast("double") - F.when(a == 0, 0.5).otherwise(0.0), F.lit(float(UNMATCHED)))


def relation_of_steps(a: Column, b: Column) -> tuple[Column, Column]:
    """Id and name of the relation; 99 and 'unrelated' for unmatched pairs."""
    key = a * 10 + b
    numbers = F.create_map(*[F.lit(x) for (p, q), (k, _) in RELATIONS.items() for x in (p * 10 + q, k)])
    names = F.create_map(*[F.lit(x) for (p, q), (_, label) in RELATIONS.items() for x in (p * 10 + q, label)])
    return F.coalesce(F.element_at(numbers, key), F.lit(UNMATCHED)), F.coalesce(F.element_at(names, key), F.lit("unrelated"))


def exclusion_pairs(nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """Directed pairs (code_i, code_j) of rows (code, excluded_codes) whose codes are known; distinct."""
    known = nodes.select(F.col("code").alias("k"))
    pairs = excluded.select(F.col("code").alias("code_i"), F.explode("excluded_codes").alias("code_j"))
    return (
        pairs.join(known, F.col("code_j") == F.col("k"), "left_semi")
        .join(known, F.col("code_i") == F.col("k"), "left_semi")
        .distinct()
    )


def pair_table(nodes: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Every kept pair with distance, relation_id, relation and whether an exclusion overrides them.

    An exclusion sets distance 0 and relation 0 in its own direction only.
    """
    steps = _steps(kept_pairs(nodes))
    number, name = relation_of_steps(F.col("a"), F.col("b"))
    pairs = steps.select(
        "idx_i", "idx_j", "code_i", "code_j",
        distance_of_steps(F.col("a"), F.col("b")).alias("distance"), number.alias("relation_id"), name.alias("relation"),
    )
    if excluded is None:
        return pairs.withColumn("excluded", F.lit(False))
    flags = exclusion_pairs(nodes, excluded).withColumn("flag", F.lit(True))
    marked = pairs.join(flags, ["code_i", "code_j"], "left").withColumn("excluded", F.coalesce("flag", F.lit(False))).drop("flag")
    return marked.withColumns(
        {
            "distance": F.when(F.col("excluded"), 0.0).otherwise(F.col("distance")),
            "relation_id": F.when(F.col("excluded"), 0).otherwise(F.col("relation_id")),
            "relation": F.when(F.col("excluded"), "excluded").otherwise(F.col("relation")),
        }
    )


def matrix(pairs: DataFrame, value: str, semantics: str = "reference") -> DataFrame:
    """Long symmetric matrix (row, col, value) with a zero diagonal left out.

    'reference': where a cell gets several rows the one last in (idx_i, idx_j) order holds; 'min':
    the least value.
    """
    cell = ["idx_i", "idx_j", F.col(value).alias("value")]
    both = pairs.select(F.col("idx_i").alias("row"), F.col("idx_j").alias("col"), *cell).unionByName(
        pairs.select(F.col("idx_j").alias("row"), F.col("idx_i").alias("col"), *cell)
    )
    if semantics == "min":
        picked = F.min("value")
    elif semantics == "reference":
        picked = F.max_by("value", F.struct("idx_i", "idx_j"))
    else:
        raise ValueError(f"unknown semantics {semantics!r}")
    return both.groupBy("row", "col").agg(picked.alias("value"))


def submatrix(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows and columns of the wanted codes (pos, index), renumbered by pos; missing and NaN cells are 0."""
    place = wanted.select(F.col("index"), F.col("pos"))
    cells = (
        long.join(place.select(F.col("index").alias("row"), F.col("pos").alias("i")), "row")
        .join(place.select(F.col("index").alias("col"), F.col("pos").alias("j")), "col")
    )
    return cells.select("i", "j", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key with their share of all rows in percent."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def lookup(pairs: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """The value of each wanted (code_a, code_b), given in either order; n_rows tells missing and double ones."""
    sides = F.array(
        F.struct(F.col("code_a").alias("code_i"), F.col("code_b").alias("code_j")),
        F.struct(F.col("code_b").alias("code_i"), F.col("code_a").alias("code_j")),
    )
    both = wanted.withColumn("s", F.explode(sides)).select("code_a", "code_b", "s.code_i", "s.code_j")
    return both.join(pairs, ["code_i", "code_j"], "left").groupBy("code_a", "code_b").agg(F.min(value).alias(value), F.count(value).alias("n_rows"))
