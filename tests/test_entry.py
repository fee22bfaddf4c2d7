import __spark_entry__ as e


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
