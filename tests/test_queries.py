import pytest
from lernwerk import plans
from oracle import SMALL, connect, same

WITHOUT = sorted(set(plans.QUERIES) - set(plans.ORACLES))


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_agrees_with_duckdb(spark, con, name):
    same(plans.QUERIES[name](spark, SMALL), con, plans.ORACLES[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs_without_oracle(spark, name):
    df = plans.QUERIES[name](spark, SMALL)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
