"""Queries of groups A (taxonomy) and B (pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeworks.operators import pairs as P
from cladeworks.operators import taxonomy as T
from cladeworks.plans.binding import CUSTOMER_TAX, EXCLUDED, PAIRS, PAIRS_EXCLUDED, SUPPLIER_TAX, customer_nodes, exclusions, parent_sql, sector_sql, supplier_nodes
from cladeworks.sources import matrices


def _level_anchors(nodes):
    return nodes.select("level", F.col("code").alias("anchor"))


def taxonomy_nodes(spark, sf):
    return customer_nodes(spark, sf).select("index", "level", "code", T.sector_of(F.col("code")).alias("sector"))


def taxonomy_sectors(spark, sf):
    nodes = customer_nodes(spark, sf)
    per = T.sector_codes(nodes).groupBy("sector").agg(F.count("*").alias("n_leaves"))
    return T.sectors(nodes).join(per, F.col("code") == F.col("sector"), "left").select("code", F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"))


def taxonomy_edges(spark, sf):
    return T.edges(customer_nodes(spark, sf))


def taxonomy_siblings(spark, sf):
    edges = T.edges(customer_nodes(spark, sf)).withColumn("ord", F.col("parent"))
    return T.siblings(edges)


def taxonomy_metadata(spark, sf):
    return T.metadata(customer_nodes(spark, sf)).select("code", "depth", F.array_join("path", ">").alias("path"), "parent")


def taxonomy_wide(spark, sf):
    return T.wide(customer_nodes(spark, sf))


def ancestors_unpivot(spark, sf):
    return T.ancestors(customer_nodes(spark, sf))


def descendants_linear_skip(spark, sf):
    nodes = customer_nodes(spark, sf)
    return T.linear_skip(nodes, _level_anchors(nodes))


def sample_positives(spark, sf):
    nodes = customer_nodes(spark, sf)
    return T.sample_positives(nodes, _level_anchors(nodes))


def pair_distances_hist(spark, sf):
    return P.counts_by(P.pair_table(customer_nodes(spark, sf)), "distance").select("distance", "n", F.round("pct", 6).alias("pct"))


def pair_relations_hist(spark, sf):
    return P.counts_by(P.pair_table(customer_nodes(spark, sf)), "relation_id", "relation").select("relation_id", "relation", "n", F.round("pct", 6).alias("pct"))


def exclusion_pairs(spark, sf):
    nodes = customer_nodes(spark, sf)
    return P.exclusion_pairs(nodes, exclusions(nodes))


def pair_distances_excluded(spark, sf):
    nodes = customer_nodes(spark, sf)
    table = P.pair_table(nodes, exclusions(nodes))
    return table.groupBy("distance", "relation_id", "relation", "excluded").agg(
        F.count("*").alias("n"), F.sum(F.col("idx_i").cast("long") * 7 + F.col("idx_j")).alias("checksum")
    )


def hierarchy_parents(spark, sf):
    return T.hierarchy(P.pair_table(customer_nodes(spark, sf)))


def _matrix_digest(long):
    return long.groupBy("row").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.sum(F.col("value") * (F.col("col") % 101)).alias("weighted"),
    )


def distance_matrix_long_reference(spark, sf):
    return _matrix_digest(P.matrix(P.pair_table(customer_nodes(spark, sf)), "distance"))


def distance_matrix_long_min(spark, sf):
    return _matrix_digest(P.matrix(P.pair_table(customer_nodes(spark, sf)), "distance", "min"))


def relation_matrix_long(spark, sf):
    table = P.pair_table(customer_nodes(spark, sf)).withColumn("relation_id", F.col("relation_id").cast("double"))
    return _matrix_digest(P.matrix(table, "relation_id"))


def distance_submatrix(spark, sf):
    nodes = customer_nodes(spark, sf)
    wanted = nodes.where("level <= 3").select("index", (F.lit(1000) - F.col("index")).alias("pos"))
    return P.submatrix(P.matrix(P.pair_table(nodes), "distance"), wanted)


def matrix_unpivot(spark, sf):
    """Wide export of the small taxonomy's matrix, read back to long form by its headers."""
    nodes = supplier_nodes(spark, sf)
    wide = matrices.to_wide(P.matrix(P.pair_table(nodes), "distance"), nodes)
    return matrices.to_long(wide).select("anchor_code", "negative_code", "value")


def _wanted(nodes):
    """Every six-digit code with its parent: a batch of point lookups given child first."""
    return nodes.where("level > 2").select(F.col("code").alias("code_a"), T.parent_code(F.col("code")).alias("code_b"))


def lookup_distance(spark, sf):
    nodes = customer_nodes(spark, sf)
    return P.lookup(P.pair_table(nodes), _wanted(nodes), "distance")


def lookup_relation(spark, sf):
    nodes = customer_nodes(spark, sf)
    return P.lookup(P.pair_table(nodes), _wanted(nodes), "relation")


QUERIES = {
    f.__name__: f
    for f in (
        taxonomy_nodes, taxonomy_sectors, taxonomy_edges, taxonomy_siblings, taxonomy_metadata, taxonomy_wide, ancestors_unpivot,
        descendants_linear_skip, sample_positives, pair_distances_hist, pair_relations_hist, exclusion_pairs, pair_distances_excluded,
        hierarchy_parents, distance_matrix_long_reference, distance_matrix_long_min, relation_matrix_long, distance_submatrix,
        matrix_unpivot, lookup_distance, lookup_relation,
    )
}

_WIDE = f"wide AS (SELECT {sector_sql('code')} AS code_2, substr(code, 1, 3) AS code_3, substr(code, 1, 4) AS code_4, substr(code, 1, 5) AS code_5, code AS code_6, code FROM nodes WHERE level = 6)"
_EDGES = f"edges AS (SELECT DISTINCT {parent_sql('child')} AS parent, child FROM (SELECT substr(code, 1, n) AS child FROM nodes, (VALUES (3), (4), (5), (6)) t(n) WHERE level = 6))"
_ANCESTORS = "anc AS (SELECT code, code_5 AS ancestor, 1 AS steps FROM wide UNION ALL SELECT code, code_4, 2 FROM wide UNION ALL SELECT code, code_3, 3 FROM wide UNION ALL SELECT code, code_2, 4 FROM wide)"
_SKIP = (
    "below AS (" + " UNION ".join(f"SELECT {k} AS level, code_{k} AS anchor, {n} AS lv, code_{n} AS code FROM wide" for k in (2, 3, 4, 5) for n in range(k + 1, 7)) + "), "
    "cnt AS (SELECT level, anchor, lv, count(*) AS n FROM below GROUP BY ALL), "
    "chosen AS (SELECT level, anchor, coalesce(min(CASE WHEN n > 1 AND level < 5 THEN lv END), 6) AS lv FROM cnt GROUP BY 1, 2), "
    "skip AS (SELECT level, anchor, code AS descendant FROM below JOIN chosen USING (level, anchor, lv))"
)
_MATRIX = """cells AS (
  SELECT idx_i AS r, idx_j AS c, idx_i, idx_j, {0} AS value FROM pairs UNION ALL SELECT idx_j, idx_i, idx_i, idx_j, {0} FROM pairs
), mat AS (SELECT r AS "row", c AS col, {1} AS value FROM cells GROUP BY 1, 2)"""
_LAST = "arg_max(value, idx_i * 1000000::BIGINT + idx_j)"
_DIGEST = 'SELECT "row", count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high, sum(value * (col % 101)) AS weighted FROM mat GROUP BY "row"'
_LOOKUP = f"""w AS (SELECT code AS code_a, {parent_sql('code')} AS code_b FROM nodes WHERE level > 2),
s AS (SELECT code_a, code_b, code_a AS code_i, code_b AS code_j FROM w UNION ALL SELECT code_a, code_b, code_b, code_a FROM w)"""

SQL = {
    "taxonomy_nodes": f'WITH {CUSTOMER_TAX} SELECT "index", level, code, {sector_sql("code")} AS sector FROM nodes',
    "taxonomy_sectors": f"WITH {CUSTOMER_TAX}, s AS (SELECT {sector_sql('code')} AS sector, count(*) AS n FROM nodes WHERE level = 6 GROUP BY 1) SELECT code, coalesce(n, 0) AS n_leaves FROM nodes LEFT JOIN s ON code = sector WHERE level = 2",
    "taxonomy_edges": f"WITH {CUSTOMER_TAX}, {_EDGES} SELECT parent, child FROM edges",
    "taxonomy_siblings": f"WITH {CUSTOMER_TAX}, {_EDGES} SELECT a.parent, a.child, b.child AS sibling FROM edges a JOIN edges b ON a.parent = b.parent AND a.child <> b.child",
    "taxonomy_metadata": f"WITH {CUSTOMER_TAX} SELECT code, level - 2 AS depth, {sector_sql('code')} || CASE WHEN level > 2 THEN '>' || array_to_string([substr(code, 1, n) FOR n IN range(3, level + 1)], '>') ELSE '' END AS path, {parent_sql('code')} AS parent FROM nodes",
    "taxonomy_wide": f"WITH {CUSTOMER_TAX}, {_WIDE} SELECT * FROM wide",
    "ancestors_unpivot": f"WITH {CUSTOMER_TAX}, {_WIDE}, {_ANCESTORS} SELECT code, ancestor, steps FROM anc",
    "descendants_linear_skip": f"WITH {CUSTOMER_TAX}, {_WIDE}, {_SKIP} SELECT level, anchor, descendant FROM skip",
    "sample_positives": f"""WITH {CUSTOMER_TAX}, {_WIDE}, {_ANCESTORS}, {_SKIP},
      pos AS (SELECT level, anchor, descendant AS positive FROM skip UNION ALL SELECT 6, code, ancestor FROM anc)
      SELECT pos.level, anchor, positive, a."index" AS anchor_idx, p."index" AS positive_idx
      FROM pos JOIN nodes a ON anchor = a.code JOIN nodes p ON positive = p.code""",
    "pair_distances_hist": f"WITH {CUSTOMER_TAX}, {PAIRS} SELECT distance, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pairs GROUP BY distance",
    "pair_relations_hist": f"WITH {CUSTOMER_TAX}, {PAIRS} SELECT relation_id, relation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM pairs GROUP BY 1, 2",
    "exclusion_pairs": f"WITH {CUSTOMER_TAX}, {EXCLUDED} SELECT code_i, code_j FROM excl WHERE code_j IS NOT NULL",
    "pair_distances_excluded": f"WITH {CUSTOMER_TAX}, {PAIRS_EXCLUDED} SELECT distance, relation_id, relation, excluded, count(*) AS n, CAST(sum(CAST(idx_i AS BIGINT) * 7 + idx_j) AS BIGINT) AS checksum FROM xpairs GROUP BY ALL",
    "hierarchy_parents": f"WITH {CUSTOMER_TAX}, {PAIRS} SELECT arg_min(code_i, idx_i) AS parent, code_j AS child FROM pairs WHERE relation_id = 1 GROUP BY code_j",
    "distance_matrix_long_reference": f"WITH {CUSTOMER_TAX}, {PAIRS}, {_MATRIX.format('distance', _LAST)} {_DIGEST}",
    "distance_matrix_long_min": f"WITH {CUSTOMER_TAX}, {PAIRS}, {_MATRIX.format('distance', 'min(value)')} {_DIGEST}",
    "relation_matrix_long": f"WITH {CUSTOMER_TAX}, {PAIRS}, {_MATRIX.format('CAST(relation_id AS DOUBLE)', _LAST)} {_DIGEST}",
    "distance_submatrix": f"""WITH {CUSTOMER_TAX}, {PAIRS}, {_MATRIX.format('distance', _LAST)}, w AS (SELECT "index", 1000 - "index" AS pos FROM nodes WHERE level <= 3)
      SELECT a.pos AS i, b.pos AS j, value FROM mat JOIN w a ON "row" = a."index" JOIN w b ON col = b."index" """,
    "matrix_unpivot": f"""WITH {SUPPLIER_TAX}, {PAIRS}, {_MATRIX.format('distance', _LAST)}
      SELECT a.code AS anchor_code, b.code AS negative_code, coalesce(value, 0.0) AS value FROM nodes a CROSS JOIN nodes b LEFT JOIN mat ON "row" = a."index" AND col = b."index" """,
    "lookup_distance": f"WITH {CUSTOMER_TAX}, {PAIRS}, {_LOOKUP} SELECT code_a, code_b, min(distance) AS distance, count(distance) AS n_rows FROM s LEFT JOIN pairs USING (code_i, code_j) GROUP BY 1, 2",
    "lookup_relation": f"WITH {CUSTOMER_TAX}, {PAIRS}, {_LOOKUP} SELECT code_a, code_b, min(relation) AS relation, count(relation) AS n_rows FROM s LEFT JOIN pairs USING (code_i, code_j) GROUP BY 1, 2",
}
