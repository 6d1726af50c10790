import pytest

import __spark_entry__
from leafline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, duck, same, name):
    same(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
