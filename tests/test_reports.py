"""Every registered report against its SQL twin, and its plan against forbidden joins."""

import pytest

import __spark_entry__ as entry
from echolens.plans import catalog

from .twins import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()  # the corpus operators have tests of their own


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_report(name, spark, duck):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PythonUDF" not in plan
    if name in TWINS:
        assert differences(df, duck, TWINS[name]) == []
    else:
        assert df.count() > 0


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == [
        "target_id", "name", "appid", "total", "analyzed", "recommend_rate", "avg_score", "pos", "neg", "neu"]


def test_twins_belong_to_reports():
    assert set(TWINS) <= set(QUERIES)
