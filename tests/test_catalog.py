"""Every registered query against SQL of the same result."""

import pytest

from auditflow.plans import catalog

#: Queries without SQL, each held against brute force in test_whole.py.
BY_BRUTE_FORCE = {"shortest_cycles", "bounded_cycles"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, small, duck, same, name):
    same(catalog.queries()[name](spark, small), duck, catalog.oracle_sql()[name])


def test_every_query_has_sql_or_brute_force():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | BY_BRUTE_FORCE


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "finding_no"
