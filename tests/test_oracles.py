"""Every query of the registry against its SQL."""

import pytest

from pathloom.plans import registry

SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, sf).count() >= 0, name
