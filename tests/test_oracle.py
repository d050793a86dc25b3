"""Every core query against its statement in SQL."""

import pytest
from compare import same

from lexiscope.plans.core import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, root, name):
    same(spark, oracle, QUERIES[name], SQL[name], root)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ml_cv", "ml_gbt", "ml_aggregator"}))
def test_query_without_sql_runs(spark, root, name):
    df = QUERIES[name](spark, root)
    assert df.columns and df.collect() is not None


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
