"""The driver's contract."""

import __spark_entry__ as e


def test_contract(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())
