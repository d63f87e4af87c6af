import __spark_entry__ as e


def test_every_oracle_is_sql_of_a_registered_query():
    assert all(isinstance(x, str) for x in e.oracle_sql().values())
    assert set(e.oracle_sql()) <= set(e.queries())
