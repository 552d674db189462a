import importlib.util

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, data):
    out = entry.entry(spark)
    assert out.columns == ["lang", "detected", "docs", "before", "after", "saved"]


def test_training_data_queries_follow_the_subpackage():
    there = importlib.util.find_spec("winnower.llm") is not None and importlib.util.find_spec("winnower.llm.registry") is not None
    assert any(q.startswith("op5_") for q in entry.queries()) == there
