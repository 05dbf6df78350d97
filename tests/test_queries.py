"""Every core query on the smallest tables, against its SQL where it has one."""

import os

import pytest

from corpuslane.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck, same_rows):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_recall_of_the_inverted_file(spark):
    assert QUERIES["ivf_recall"](spark, DATA).first()["recall"] >= 0.9


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
