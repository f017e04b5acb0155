"""Taxonomies and vectors bound to the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeworks.functions import vectors as V
from cladeworks.operators import taxonomy
from cladeworks.sources.stages import staged

SECTORS = {0: "11", 1: "31", 2: "32", 3: "44", 4: "45"}
SEGMENTS = {"AUTOMOBILE": "1", "BUILDING": "2", "FURNITURE": "3", "HOUSEHOLD": "4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    sector = F.element_at(F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv]), F.col("n_regionkey"))
    digit = F.dense_rank().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return nation.select("n_nationkey", F.concat(sector, digit.cast("string")).alias("head"))


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large taxonomy: sector, nation, market segment and two digits of the customer key."""
    segment = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SEGMENTS.items() for x in kv]), F.col("c_mktsegment")), F.lit("5"))
    key = F.col("c_custkey")
    leaves = (
        table(spark, sf_dir, "customer").join(_nation_digits(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.concat("head", segment, (1 + key % 3).cast("string"), (1 + F.floor(key / 3) % 4).cast("string")).alias("code"))
        .distinct()
    )
    return staged(taxonomy.nodes_from_leaves(leaves), "nodes")


def supplier_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small taxonomy, for operators whose results grow with the cube of its nodes."""
    key = F.col("s_suppkey")
    leaves = (
        table(spark, sf_dir, "supplier").join(_nation_digits(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat("head", (1 + key % 2).cast("string"), (1 + F.floor(key / 2) % 2).cast("string"), (1 + F.floor(key / 4) % 2).cast("string")).alias("code"))
        .distinct()
    )
    return staged(taxonomy.nodes_from_leaves(leaves), "nodes")


def exclusions(nodes: DataFrame) -> DataFrame:
    """Every 37th six-digit code excludes the two six-digit codes after it."""
    order = Window.orderBy("index")
    leaf = nodes.where("level = 6").select("index", "code", F.array_compact(F.array(F.lead("code", 1).over(order), F.lead("code", 2).over(order))).alias("excluded_codes"))
    return leaf.where("index % 37 = 0").select("code", "excluded_codes")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as id, label, v (doubles) and x, lifted onto the hyperboloid."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles(F.col("embedding")).alias("v"))
    return e.withColumn("x", V.lift(F.col("v")))


# --- the same in SQL, as common table expressions

_HEAD = """heads AS (
  SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '11' WHEN 1 THEN '31' WHEN 2 THEN '32' WHEN 3 THEN '44' ELSE '45' END
    || CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS VARCHAR) AS head
  FROM nation)"""
_SECTOR = "CASE substr({0}, 1, 2) WHEN '32' THEN '31' WHEN '33' THEN '31' WHEN '45' THEN '44' WHEN '49' THEN '48' ELSE substr({0}, 1, 2) END"


def sector_sql(code: str) -> str:
    return _SECTOR.format(code)


def parent_sql(code: str) -> str:
    return f"CASE WHEN length({code}) = 3 THEN {sector_sql(code)} WHEN length({code}) > 3 THEN substr({code}, 1, length({code}) - 1) END"


_NODES = f"""nodes AS (
  SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS "index", CAST(length(code) AS INTEGER) AS level, code
  FROM (
    SELECT DISTINCT substr(code, 1, n) AS code FROM leaves, (VALUES (3), (4), (5), (6)) t(n)
    UNION SELECT DISTINCT {sector_sql('code')} FROM leaves))"""

CUSTOMER_TAX = f"""{_HEAD}, leaves AS (
  SELECT DISTINCT head || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3'
      WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END
    || CAST(1 + c_custkey % 3 AS VARCHAR) || CAST(1 + (c_custkey // 3) % 4 AS VARCHAR) AS code
  FROM customer JOIN heads ON c_nationkey = n_nationkey), {_NODES}"""
SUPPLIER_TAX = f"""{_HEAD}, leaves AS (
  SELECT DISTINCT head || CAST(1 + s_suppkey % 2 AS VARCHAR) || CAST(1 + (s_suppkey // 2) % 2 AS VARCHAR)
    || CAST(1 + (s_suppkey // 4) % 2 AS VARCHAR) AS code
  FROM supplier JOIN heads ON s_nationkey = n_nationkey), {_NODES}"""

EXCLUDED = """excl AS (
  SELECT code AS code_i, unnest([x, y]) AS code_j FROM (
    SELECT "index", code, lead(code, 1) OVER (ORDER BY "index") AS x, lead(code, 2) OVER (ORDER BY "index") AS y
    FROM nodes WHERE level = 6) WHERE "index" % 37 = 0)"""

# Fixed values, written out apart from the operators: steps from both sides to the common ancestor, number and name of the relation.
_RELATIONS = (
    (0, 1, 1, "child"), (1, 1, 2, "sibling"), (0, 2, 3, "grandchild"), (0, 3, 4, "great-grandchild"), (1, 2, 5, "nephew/niece"),
    (0, 4, 6, "great-great-grandchild"), (2, 2, 7, "cousin"), (1, 3, 8, "grand-nephew/niece"), (1, 4, 9, "grand-grand-nephew/niece"),
    (2, 3, 10, "cousin_1_times_removed"), (3, 3, 11, "second_cousin"), (2, 4, 12, "cousin_2_times_removed"),
    (3, 4, 13, "second_cousin_1_times_removed"), (4, 4, 14, "third_cousin"),
)
_NUMBERS = " ".join(f"WHEN a = {a} AND b = {b} THEN {n}" for a, b, n, _ in _RELATIONS)
_LABELS = " ".join(f"WHEN a = {a} AND b = {b} THEN '{name}'" for a, b, _, name in _RELATIONS)

PAIRS = f"""kept AS (
  SELECT i."index" AS idx_i, j."index" AS idx_j, i.code AS code_i, j.code AS code_j, i.level AS li, j.level AS lj
  FROM nodes i, nodes j WHERE i.level <= j.level
    AND ((substr(i.code, 1, 2) = substr(j.code, 1, 2) AND i.code < j.code) OR substr(i.code, 1, 2) <> substr(j.code, 1, 2))
), lca AS (
  SELECT *, CASE WHEN CAST(code_i AS INTEGER) >= CAST(code_j AS INTEGER) OR {sector_sql('code_i')} <> {sector_sql('code_j')} THEN NULL
    WHEN substr(code_i, 1, 2) <> substr(code_j, 1, 2) THEN 2
    ELSE list_max([n FOR n IN range(2, li + 1) IF substr(code_i, 1, n) = substr(code_j, 1, n)]) END AS lca
  FROM kept
), steps AS (SELECT *, li - lca AS a, lj - lca AS b FROM lca),
pairs AS (
  SELECT idx_i, idx_j, code_i, code_j,
    coalesce(CAST(a + b AS DOUBLE) - CASE WHEN a = 0 THEN 0.5 ELSE 0.0 END, 99.0) AS distance,
    CAST(CASE WHEN a IS NULL THEN 99 {_NUMBERS} END AS INTEGER) AS relation_id,
    CASE WHEN a IS NULL THEN 'unrelated' {_LABELS} END AS relation
  FROM steps)"""
PAIRS_EXCLUDED = f"""{EXCLUDED}, {PAIRS}, xpairs AS (
  SELECT idx_i, idx_j, p.code_i, p.code_j, CASE WHEN e.code_i IS NULL THEN distance ELSE 0.0 END AS distance,
    CASE WHEN e.code_i IS NULL THEN relation_id ELSE 0 END AS relation_id,
    CASE WHEN e.code_i IS NULL THEN relation ELSE 'excluded' END AS relation, e.code_i IS NOT NULL AS excluded
  FROM pairs p LEFT JOIN excl e ON p.code_i = e.code_i AND p.code_j = e.code_j)"""

VECTORS = """vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
lifted AS (SELECT id, label, v, list_concat([sqrt(list_inner_product(v, v) + 1.0)], v) AS x FROM vec)"""
