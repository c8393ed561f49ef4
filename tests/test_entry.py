"""Every oracle belongs to a query; the flagship runs."""

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 80 and set(o) <= set(q)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
