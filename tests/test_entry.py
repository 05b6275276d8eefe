"""The driver's contract."""

import __spark_entry__ as entry


def test_names(spark):
    names = entry.queries()
    assert len(names) > 50 and set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
