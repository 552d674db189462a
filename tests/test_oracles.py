"""Every query that SQL can express, against DuckDB on the small tables."""

import pytest
from conftest import same

from winnower import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, data, duck):
    same(registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(name, spark, data):
    out = registry.QUERIES[name](spark, data)
    assert out.count() > 0
    assert len(set(out.columns)) == len(out.columns)
