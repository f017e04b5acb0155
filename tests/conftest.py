import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from cladeworks.session import session

    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a query with its SQL over the smallest tables: columns by name, rows in any order."""

    def plain(value):
        if value is None or value != value:
            return "NULL"
        return f"{value:.6f}" if isinstance(value, float) else str(value)

    def check(query, sql):
        frame = query(spark, SMALL)
        names = sorted(frame.columns)
        got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
        cursor = duck.execute(sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        want = sorted(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
        assert got == want

    return check
