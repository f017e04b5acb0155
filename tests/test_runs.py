"""Checks before a run, the state it goes on from, its summary."""

import json

import pytest
from pyspark.sql import functions as F

from cladeworks import config, jobs, runs


def made(spark, data):
    kinds = {"index": "int", "level": "int", "excluded_codes": "array<string>", "distance": "double", "margin": "double", "relation_id": "int"}
    for name in runs.NEEDED:
        columns = jobs.REQUIRED[name]
        schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)
        spark.createDataFrame([tuple(None for _ in columns)], schema).write.parquet(f"{data}/{name}")


def tokens(spark, lengths):
    return spark.range(3).select(*[F.array_repeat(F.lit(1), n).alias(f"{c}_{part}") for c, n in lengths.items() for part in ("ids", "mask")])


def test_every_fault_is_listed(spark, tmp_path):
    data = str(tmp_path)
    found = runs.preflight(spark, data, ("sampling.seed=x=y", "model.top_k=9"))
    assert len(found.errors) == 5 and any("top_k" in e for e in found.errors) and any("tokens" in w for w in found.warnings)
    with pytest.raises(ValueError, match="taxonomy.*distances"):
        runs.require(found)
    made(spark, data)
    assert runs.preflight(spark, data).valid
    tokens(spark, runs.CHANNELS).write.parquet(f"{data}/tokens")
    assert runs.preflight(spark, data, ("sampling.seed=7",)).valid and not runs.preflight(spark, data).warnings
    tokens(spark, runs.CHANNELS | {"title": 9}).write.mode("overwrite").parquet(f"{data}/tokens")
    assert runs.preflight(spark, data).errors == ["tokens: 3 rows of title are not 24 long"]
    tokens(spark, {"title": 24}).write.mode("overwrite").parquet(f"{data}/tokens")
    assert "description_ids" in runs.preflight(spark, data).errors[0]
    tokens(spark, runs.CHANNELS).limit(0).write.mode("overwrite").parquet(f"{data}/tokens")
    assert "tokens: no rows" in runs.preflight(spark, data).errors


def test_state_to_go_on_from(spark, tmp_path):
    root = tmp_path / "states"
    (root / "one").mkdir(parents=True)
    assert runs.resolved(spark, None, str(root), "one") == runs.resolved(spark, "last", str(root), "one") == runs.Checkpoint()
    (root / "one" / "last.ckpt").write_text("{}")
    (root / "one" / "epoch=3.ckpt").write_text("{}")
    assert runs.resolved(spark, "LAST", str(root), "one") == runs.Checkpoint(f"{root}/one/last.ckpt", True)
    assert runs.resolved(spark, f"{root}/one/epoch=3.ckpt", f"{root}/", "one").same_experiment
    other = runs.resolved(spark, f"{root}/one/epoch=3.ckpt", str(root), "two")
    assert other.exists and not other.same_experiment
    assert not runs.resolved(spark, f"{root}/none.ckpt", str(root), "one").exists
    assert runs.split_changes(["a=1", "b", "c=d=e"]) == (["a=1", "c=d=e"], ["b"]) and runs.split_changes(None) == ([], [])


def test_summary_of_a_run(spark, tmp_path):
    rows = [(1, 0, 1.0, 0.9, 0.1), (1, 1, 0.8, 0.5, 0.2), (1, 2, 0.7, 0.5, 0.3), (1, 3, 0.7, None, 0.4), (2, 0, 1.0, float("nan"), 0.1), (2, 4, 0.1, 0.2, 0.6)]
    history = spark.createDataFrame(rows, "run int, epoch int, train_loss double, val_loss double, mrr double")
    got = {r.run: r.asDict() for r in runs.results(history, 5).collect()}
    assert got[1] == {"run": 1, "best_loss": 0.5, "best_epoch": 1, "stopped_epoch": 2, "early_stopped": True, "last_mrr": 0.3} and not got[2]["early_stopped"]
    for _ in range(2):
        paths = runs.save_summary(spark, f"{tmp_path}/out", "one", got[1], config.Config(), {"ndcg": 0.5})
    content = json.loads(open(paths["json"]).read())
    assert content["results"]["best_loss"] == 0.5 and content["training_run"]["early_stopped"] and content["config_snapshot"]["sampling"]["seed"] == 42
    with pytest.raises(ValueError, match="unknown format"):
        runs.save_summary(spark, f"{tmp_path}/out", "one", got[1], config.Config(), kinds=("xml",))
