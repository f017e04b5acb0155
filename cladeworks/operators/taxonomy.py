"""Code taxonomies: nodes, edges, ancestors, descendants, siblings.

A node is a code of 2 to 6 digits; its level is its length and its parent its prefix. Some
two-digit sectors are one sector under several prefixes: they share the root of the first.
Tables have columns index, level, code; their size is bounded by the codes of six digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sectors that are reported under another one's prefix.
MERGED = {"32": "31", "33": "31", "45": "44", "49": "48"}
LEVELS = (2, 3, 4, 5, 6)


def merged_sector(prefix: Column) -> Column:
    """The root of a two-digit prefix."""
    out = F.when(F.lit(False), prefix)
    for other, root in MERGED.items():
        out = out.when(prefix == other, F.lit(root))
    return out.otherwise(prefix)


def sector_of(code: Column) -> Column:
    return merged_sector(F.substring(code, 1, 2))


def nodes_from_leaves(leaves: DataFrame) -> DataFrame:
    """All nodes over the given six-digit codes: prefixes of three digits and more, and merged roots."""
    prefixes = leaves.select(
        F.explode(F.array_append(F.transform(F.sequence(F.lit(3), F.lit(6)), lambda n: F.substring(F.col("code"), F.lit(1), n)), sector_of(F.col("code")))).alias("code")
    ).distinct()
    return prefixes.select(
        (F.row_number().over(Window.orderBy("code")) - 1).cast("int").alias("index"), F.length("code").alias("level"), "code"
    )


def sectors(nodes: DataFrame) -> DataFrame:
    """Two-digit codes in numeric order."""
    return nodes.where("level = 2").select("code").orderBy(F.col("code").cast("int"))


def sector_codes(nodes: DataFrame) -> DataFrame:
    """Each sector with its six-digit codes."""
    return nodes.where("level = 6").select(sector_of(F.col("code")).alias("sector"), "code")


def parent_code(code: Column) -> Column:
    """The prefix one digit shorter, the merged root for three digits, null for a root."""
    return F.when(F.length(code) == 3, sector_of(code)).when(F.length(code) > 3, F.substring(code, F.lit(1), F.length(code) - 1))


def edges(nodes: DataFrame) -> DataFrame:
    """Parent and child of every tree edge that lies above a six-digit code."""
    leaf = nodes.where("level = 6")
    steps = F.transform(F.sequence(F.lit(3), F.lit(6)), lambda n: F.substring(F.col("code"), F.lit(1), n))
    return leaf.select(F.explode(steps).alias("child")).distinct().select(parent_code(F.col("child")).alias("parent"), "child")


def path(code: Column) -> Column:
    """Codes from the merged root down to the code itself."""
    tail = F.when(
        F.length(code) > 2, F.transform(F.sequence(F.lit(3), F.length(code)), lambda n: F.substring(code, F.lit(1), n))
    ).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(F.array(sector_of(code)), tail)


def metadata(nodes: DataFrame) -> DataFrame:
    """Depth under the root, path from the root and parent of every node."""
    code = F.col("code")
    return nodes.select("code", (F.col("level") - 2).alias("depth"), path(code).alias("path"), parent_code(code).alias("parent"))


def siblings(pairs: DataFrame) -> DataFrame:
    """From (parent, child) rows in arrival order ord: child and sibling, under each child's first parent."""
    first = pairs.groupBy("child").agg(F.min_by("parent", "ord").alias("parent"))
    other = first.select("parent", F.col("child").alias("sibling"))
    return first.join(other, "parent").where("child <> sibling").select("parent", "child", "sibling")


def hierarchy(relations: DataFrame) -> DataFrame:
    """Parent-child pairs (parent, child) from a relation table's rows of relation 1, the first parent of a child kept."""
    pairs = relations.where("relation_id = 1").select(F.col("code_i").alias("parent"), F.col("code_j").alias("child"), F.struct("idx_i", "idx_j").alias("ord"))
    return pairs.groupBy("child").agg(F.min_by("parent", "ord").alias("parent")).select("parent", "child")


def wide(nodes: DataFrame) -> DataFrame:
    """Six-digit codes with their ancestors: code_2 (merged) to code_6."""
    code = F.col("code")
    return nodes.where("level = 6").select(
        sector_of(code).alias("code_2"), *[F.substring(code, 1, n).alias(f"code_{n}") for n in (3, 4, 5, 6)], code
    )


def anchors(triplets: DataFrame) -> DataFrame:
    """Distinct (level, anchor) of a triplet table, by level and numeric code."""
    named = triplets.select(F.col("anchor_level").alias("level"), F.col("anchor_code").alias("anchor")).distinct()
    return named.orderBy("level", F.col("anchor").cast("int"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """Every ancestor of the six-digit codes with its distance in steps, nearest first."""
    long = wide(nodes).select("code", "code_5", "code_4", "code_3", "code_2").unpivot("code", ["code_5", "code_4", "code_3", "code_2"], "name", "ancestor")
    return long.select("code", "ancestor", (6 - F.substring("name", 6, 1).cast("int")).alias("steps"))


def linear_skip(nodes: DataFrame, anchor_codes: DataFrame) -> DataFrame:
    """Descendants of each anchor (level, anchor) at the first deeper level that has more than one of them.

    Anchors of level 5, and those without such a level, get their six-digit descendants; anchors
    of level 6 have none.
    """
    table = wide(nodes)
    below = None
    for level in (2, 3, 4, 5):
        deeper = F.array(*[F.struct(F.lit(n).alias("at"), F.col(f"code_{n}").alias("code")) for n in range(level + 1, 7)])
        part = (
            anchor_codes.where(F.col("level") == level)
            .join(table.withColumnRenamed("code", "leaf"), F.col("anchor") == F.col(f"code_{level}"))
            .select("level", "anchor", F.explode(deeper).alias("d"))
            .select("level", "anchor", "d.at", "d.code")
            .distinct()
        )
        below = part if below is None else below.unionByName(part)
    counts = below.groupBy("level", "anchor", "at").agg(F.count("*").alias("n"))
    wide_enough = F.when((F.col("n") > 1) & (F.col("level") < 5), F.col("at"))
    chosen = counts.groupBy("level", "anchor").agg(F.coalesce(F.min(wide_enough), F.lit(6)).alias("at"))
    return below.join(chosen, ["level", "anchor", "at"]).select("level", "anchor", F.col("code").alias("descendant"))


def sample_positives(nodes: DataFrame, anchor_codes: DataFrame) -> DataFrame:
    """Positives of each anchor: skipped-to descendants above level 6, ancestors of level 6, with both indices."""
    down = linear_skip(nodes, anchor_codes).select("level", "anchor", F.col("descendant").alias("positive"))
    up = anchor_codes.where("level = 6").join(ancestors(nodes), F.col("anchor") == F.col("code")).select("level", "anchor", F.col("ancestor").alias("positive"))
    ids = nodes.select("index", "code")
    return (
        down.unionByName(up)
        .join(ids.select(F.col("index").alias("anchor_idx"), F.col("code").alias("anchor")), "anchor")
        .join(ids.select(F.col("index").alias("positive_idx"), F.col("code").alias("positive")), "positive")
        .select("level", "anchor", "positive", "anchor_idx", "positive_idx")
    )
