"""Records that share a code, as documents beyond 72,000 do in doc_fill_missing."""

from cladeworks.operators import textetl
from cladeworks.plans import graph_text_plans


def test_records_that_share_a_code_are_texts_of_their_own(spark):
    rows = [(1, "10001", "This industry A"), (72008, "10001", "This industry B"), (72009, "10002", ""), (2, "10002", ""), (6, "100020", "This industry C"), (0, "1000", ""), (3, "1001", "")]
    clean = spark.createDataFrame([(d, c, 1, t) for d, c, t in rows], "doc_id bigint, code string, description_id int, description string")
    none = spark.createDataFrame([(72008, "10001", 1)], "doc_id bigint, code string, description_id int")
    starts = spark.createDataFrame([], "doc_id bigint, code string, description_id_min int")
    got = sorted(map(tuple, textetl.filled(clean, none, starts, "doc_id").collect()))
    assert got == sorted([("10001", "This industry A"), ("100020", "This industry C"), ("10002", "This NAICS industry C"), ("10002", "This NAICS industry C"), ("1000", "This industry group A")])
    none = spark.createDataFrame([], "doc_id bigint, code string, description_id int")
    got = dict(map(tuple, textetl.filled(clean, none, starts, "doc_id").where("length(code) = 4").collect()))
    assert got == {"1000": "This industry group A"}  # of two children with 1 the one of the least record


def test_query_agrees_with_its_sql_where_documents_share_codes(spark, duck, tmp_path):
    ids = [*range(16), 25, 72_248, 72_009, 72_024, *range(80_000, 80_320)]  # no tie that the SQL leaves open
    docs = spark.createDataFrame([(i, f"makes things {i}") for i in ids], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, graph_text_plans.doc_fill_missing(spark, str(tmp_path)).collect()))
    sql = graph_text_plans.SQL["doc_fill_missing"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duck.execute(sql).fetchall())
    assert len({code for code, _ in got}) < len(got)  # some share a code
