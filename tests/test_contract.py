import __spark_entry__ as contract


def test_every_oracle_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150 and len(oracles) > 120


def test_flagship_runs(spark):
    row = contract.entry(spark).first()
    assert row.verdict in ("flagged", "suspect", "clean")
