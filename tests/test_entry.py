"""The driver's contract."""

import __spark_entry__ as entry
from lodestream import queries


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq", "event_id", "delivery_id"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.ORACLE) <= set(queries.QUERIES)


def test_without_the_training_data_operators(monkeypatch):
    monkeypatch.setattr(entry, "_has", lambda name: False)
    assert set(entry.queries()) == set(queries.QUERIES)
