"""Every query of the package on the smallest tables, against its SQL where it has one."""

import os

import pytest

from corpuslane.llm.queries import QUERIES
from corpuslane.llm.sql import SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck, same_rows):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize(("name", "branches"), [("p1_found", 3), ("p1_pieces", 3), ("p5_found", 1), ("p5_redacted", 1)])
def test_python_runs_once_per_text(spark, name, branches):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == branches
