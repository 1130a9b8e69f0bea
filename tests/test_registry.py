import __spark_entry__


def test_queries_and_oracles():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 70


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
