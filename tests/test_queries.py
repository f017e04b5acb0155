"""Every query with SQL agrees with it; the others give rows of the same shape twice."""

import pytest

from cladeworks.plans import catalog

SQL = catalog.oracle_sql()
OTHERS = sorted(set(catalog.queries()) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(name, same_rows):
    same_rows(catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", OTHERS)
def test_gives_rows(name, spark):
    frame = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert frame.columns and frame.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
