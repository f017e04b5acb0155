"""Queries over documents read every text."""

from cladeworks.plans import graph_text_plans


def test_subword_tokens_cuts_every_text(spark, duck, tmp_path):
    docs = spark.createDataFrame([(i, "web", f"text number {i}, er und sie") for i in range(11)], "doc_id bigint, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, graph_text_plans.subword_tokens(spark, str(tmp_path)).collect()))
    assert min(r[-1] for r in got) > 10  # pieces of a text, not those of an empty one
    sql = graph_text_plans.SQL["subword_tokens"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duck.execute(sql).fetchall())
