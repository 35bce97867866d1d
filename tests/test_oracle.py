"""Every registered query against its SQL on the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from check import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {q.__name__ for q in entry._QUERIES} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) == ""


def test_cross_validation_runs(spark, sf):
    rows = entry.lr_fold_metrics(spark, sf).collect()
    assert [r["span"] for r in sorted(rows)] == ["1998-1999", "1999-2000", "2000-2001"]
    assert all(0 <= r["accuracy"] <= 1 and r["loss"] > 0 for r in rows)


def test_the_comparison_sees_differences(spark, sf, con):
    df = entry.fold_table(spark, sf)
    assert "rows" in compare(df.limit(1), con, entry.oracle_sql()["fold_table"])
    assert "!=" in compare(df.withColumn("n_val", df.n_val + 1), con, entry.oracle_sql()["fold_table"])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "publication_date_int", "features", "target"]
    assert df.count() == 1500
