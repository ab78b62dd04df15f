from __spark_entry__ import entry, oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry(spark).count() == 1


def test_oracle_names():
    assert set(oracle_sql()) <= set(queries())
