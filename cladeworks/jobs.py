"""Batch jobs: `python -m cladeworks.jobs JOB --data DIR`. Tables are Parquet folders in DIR.

preprocess reads titles, descriptions, cross_references and examples and writes taxonomy;
relations and distances read taxonomy, triplets reads distances and relations; all runs them in order.
curriculum reads taxonomy, relations, distances and training_pairs and writes node_scores, relation_cardinality and
difficulty_thresholds. verify compares encodings before and after; investigate describes the distances, report a training history;
tokens reads taxonomy and vocabulary (piece, id) and writes tokens, once; check looks whether the tables are there; config prints the settings (--settings FILE, and changes like sampling.seed=7).
"""

from __future__ import annotations

import argparse
import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks import config
from cladeworks.operators import control, evaluation, graph, metrics, pairs, pairwise, subwords, textetl, triplets
from cladeworks.session import session
from cladeworks.sources import artifacts, leases
from cladeworks.sources.stages import staged

REQUIRED = {
    "titles": ["index", "code", "title"], "descriptions": ["code", "description"], "cross_references": ["code", "ord", "excluded"], "examples": ["code", "ord", "examples"],
    "training_pairs": ["anchor_idx", "positive_idx", "negative_idx", "margin"], "history": ["run", "epoch", "train_loss", "val_loss", "mrr", "phase", "plateau", "action"],
    "taxonomy": ["index", "level", "code", "excluded_codes"], "relations": ["idx_i", "idx_j", "code_i", "code_j", "relation_id", "relation"], "distances": ["idx_i", "idx_j", "code_i", "code_j", "distance"],
}


def read(spark: SparkSession, data: str, name: str) -> DataFrame:
    """A table of the data folder, its columns checked."""
    df = spark.read.parquet(f"{data}/{name}")
    found = artifacts.check_schema(df, REQUIRED.get(name, []), name)
    if not found.valid:
        raise ValueError("; ".join(found.errors))
    return df


def preprocess(spark: SparkSession, data: str) -> None:
    inputs = [read(spark, data, n) for n in ("titles", "descriptions", "cross_references", "examples")]
    artifacts.write_single(textetl.description_table(*inputs), f"{data}/taxonomy")


def _pairs(spark: SparkSession, data: str) -> DataFrame:
    nodes = read(spark, data, "taxonomy")
    excluded = nodes.where("excluded_codes is not null").select("code", "excluded_codes")
    return pairs.pair_table(nodes.select("index", "level", "code"), excluded)


def relations(spark: SparkSession, data: str) -> None:
    _pairs(spark, data).select(*REQUIRED["relations"]).write.mode("overwrite").parquet(f"{data}/relations")


def distances(spark: SparkSession, data: str) -> None:
    _pairs(spark, data).select(*REQUIRED["distances"]).write.mode("overwrite").parquet(f"{data}/distances")


def training_pairs(spark: SparkSession, data: str) -> None:
    key = ["idx_i", "idx_j", "code_i", "code_j"]
    both = staged(read(spark, data, "relations").join(read(spark, data, "distances"), key), "pairs")
    capped = triplets.cap_unrelated(triplets.triplets(both), triplets.seeded_order(42, "anchor_idx", "positive_idx", "negative_idx"))
    triplets.write_partitioned(capped, f"{data}/training_pairs")


def verify(spark: SparkSession, data: str) -> None:
    """Encodings before and after (index, code, hyp_e0…): ranking by tree distance must not get much worse."""
    tree = read(spark, data, "distances")
    known = tree.select(F.col("idx_i").alias("id_i"), F.col("idx_j").alias("id_j"), F.col("distance").alias("t"))
    both = known.unionByName(known.select(F.col("id_j").alias("id_i"), F.col("id_i").alias("id_j"), "t")).groupBy("id_i", "id_j").agg(F.min("t").alias("t"))

    def bundle(name: str) -> DataFrame:
        v = artifacts.to_vectors(read(spark, data, name)).select(F.col("index").cast("long").alias("id"), "x")
        p = pairwise.all_pairs(v, "lorentz", "x", True).withColumnRenamed("value", "d").join(both, ["id_i", "id_j"])
        coph = metrics.cophenetic(p.where("id_i < id_j")).select(F.lit("cophenetic").alias("metric"), F.col("correlation").alias("value"))
        return coph.unionByName(metrics.ndcg_ranking(p, (10,)).select(F.lit("ndcg_10").alias("metric"), F.col("ndcg").alias("value")))

    metrics.verify_change(bundle("encodings_before"), bundle("encodings_after"), {"cophenetic": 0.02, "ndcg_10": 0.01}).show(truncate=False)


def investigate(spark: SparkSession, data: str) -> None:
    pairs.counts_by(read(spark, data, "distances"), "distance").orderBy("distance").show(50)


CHANNELS = {"title": 24, "description": 512, "excluded": 512, "examples": 512}


def tokens(spark: SparkSession, data: str) -> None:
    """Sub-word ids of all channels, by the pieces of the table vocabulary (piece, id); made once, however many of these jobs run."""
    token_cache(spark, data).groupBy().agg(*[F.count_if(F.aggregate(f"{c}_mask", F.lit(0), lambda s, x: s + x) > 0).alias(c) for c in CHANNELS]).show()


def token_cache(spark: SparkSession, data: str) -> DataFrame:
    """What tokens() has made, or makes."""
    texts = lambda: read(spark, data, "taxonomy").select("index", *CHANNELS)
    return leases.made_once(spark, f"{data}/tokens", lambda: subwords.encoded(texts(), "index", CHANNELS, read(spark, data, "vocabulary")))


def curriculum(spark: SparkSession, data: str) -> None:
    """Scores of nodes, classes of relations and difficulty limits, each written as a table."""
    both = staged(read(spark, data, "relations").join(read(spark, data, "distances"), ["idx_i", "idx_j", "code_i", "code_j"]), "pairs")
    nodes = read(spark, data, "taxonomy").select(F.col("index").alias("id"), "level")
    edges = both.where("relation_id = 1").select(F.col("idx_i").alias("src"), F.col("idx_j").alias("dst"))
    artifacts.write_single(graph.node_scores(edges, nodes), f"{data}/node_scores")
    artifacts.write_single(graph.relation_cardinality(both), f"{data}/relation_cardinality")
    artifacts.write_single(graph.difficulty_thresholds(both, read(spark, data, "training_pairs")), f"{data}/difficulty_thresholds")


def curriculum_tables(spark: SparkSession, data: str) -> dict[str, DataFrame]:
    """What curriculum() has written."""
    return {name: spark.read.parquet(f"{data}/{name}") for name in ("node_scores", "relation_cardinality", "difficulty_thresholds")}


def report(spark: SparkSession, data: str) -> None:
    history = read(spark, data, "history")
    print(evaluation.report(control.phase_summary(history)))
    evaluation.trends(history, "mrr").show(truncate=False)


def check(spark: SparkSession, data: str) -> None:
    found = artifacts.check_tables(spark, data, {n: REQUIRED[n] for n in ("taxonomy", "relations", "distances", "training_pairs")})
    for kind, lines in (("error", found.errors), ("warning", found.warnings)):
        for line in lines:
            print(f"{kind}: {line}")
    print("valid" if found.valid else "not valid")


JOBS: dict[str, list[Callable[[SparkSession, str], None]]] = {
    "preprocess": [preprocess], "relations": [relations], "distances": [distances], "triplets": [training_pairs],
    "all": [preprocess, relations, distances, training_pairs], "verify": [verify], "investigate": [investigate],
    "curriculum": [curriculum], "tokens": [tokens], "report": [report], "check": [check],
}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=[*JOBS, "config"])
    parser.add_argument("changes", nargs="*", help="settings like sampling.seed=7, for config")
    parser.add_argument("--data")
    parser.add_argument("--settings")
    given = parser.parse_args(args)
    if given.job == "config":
        print(json.dumps(dataclasses.asdict(config.overridden(config.load(given.settings), *given.changes)), indent=2))
        return
    if not given.data:
        parser.error("--data is required")
    spark = session(f"cladeworks-{given.job}")
    for job in JOBS[given.job]:
        job(spark, given.data)


if __name__ == "__main__":
    main()
