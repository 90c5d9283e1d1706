"""Every named query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_entry(spark):
    assert entry_module.entry(spark).count() == 3


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    frame = entry_module.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    found = frame.toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    assert difference(found, con.execute(ORACLES[name]).df()) is None
