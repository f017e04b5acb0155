import os
from types import SimpleNamespace

import numpy as np
import pytest

from cladeworks import jobs
from cladeworks.operators import graph, subwords
from cladeworks.operators.inference import embedded
from cladeworks.sources import stages


def test_jobs_from_texts_to_triplets(spark, tmp_path, capsys):
    data = str(tmp_path)
    codes = ["11", "111", "1111", "11111", "111111", "111112", "1112", "11121", "111211", "112", "1121", "11211", "112111"]
    spark.createDataFrame([(i + 1, c, f"T{c}") for i, c in enumerate(codes)], "index int, code string, title string").write.parquet(f"{data}/titles")
    spark.createDataFrame([(c, f"About {c}") for c in codes], "code string, description string").write.parquet(f"{data}/descriptions")
    spark.createDataFrame([("111111", 0, "not 112111")], "code string, ord int, excluded string").write.parquet(f"{data}/cross_references")
    spark.createDataFrame([("11", 0, "e")], "code string, ord int, examples string").write.parquet(f"{data}/examples")
    for job in jobs.JOBS["all"]:
        job(spark, data)
    assert spark.read.parquet(f"{data}/taxonomy").count() == len(codes)
    excluded = spark.read.parquet(f"{data}/distances").where("distance = 0").collect()
    assert [(r.code_i, r.code_j) for r in excluded] == [("111111", "112111")]
    rows = spark.read.parquet(f"{data}/training_pairs")
    assert rows.count() > 0 and "anchor" in rows.columns and rows.where("margin <= 0").count() == 0
    subwords.vocabulary(spark, ["t", "about", "##1", "##2", "1", "2", "not", "e"]).write.parquet(f"{data}/vocabulary")
    jobs.tokens(spark, data)
    top = spark.read.parquet(f"{data}/taxonomy").where("code = '11'").first()["index"]
    first = jobs.token_cache(spark, data).where(f"index = {top} and window = 0").first()
    assert first.title_ids[:6] == [2, 5, 7, 7, 3, 0] and len(first.title_ids) == 24 and first.description_ids[:3] == [2, 6, 9] and sum(first.excluded_mask) == 3
    rng = np.random.default_rng(0)
    for name in ("before", "after"):
        v = [(i, c, *[float(x) for x in (1.5, *rng.normal(size=2))]) for i, c in enumerate(codes)]
        spark.createDataFrame(v, "index int, code string, hyp_e0 double, hyp_e1 double, hyp_e2 double").write.parquet(f"{data}/encodings_{name}")
    jobs.verify(spark, data)
    jobs.investigate(spark, data)
    assert "cophenetic" in capsys.readouterr().out


def test_embedding_slot(spark):
    df = spark.createDataFrame([(0, 2, "11", "abc"), (1, 3, "111", None)], "index int, level int, code string, text string")
    got = embedded(df, "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert sorted((r["index"], r.x) for r in got) == [(0, [3.0, 1.0]), (1, [0.0, 1.0])]


def test_staged_tables_go_away(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "shared_dir", lambda _: str(tmp_path))
    edges = graph.mirrored(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src int, dst int"))
    assert {r.id: r.core for r in graph.kcore(edges, spark.range(4)).collect()} == {0: 2, 1: 2, 2: 2, 3: 1}
    root = stages.stage_root(spark)
    assert root.startswith(str(tmp_path)) and len(os.listdir(root)) == 1  # of all rounds the last one is left
    stages.clear(spark)
    assert not os.path.exists(root)


def test_a_cluster_needs_a_shared_folder():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stages.shared_dir(spark)
