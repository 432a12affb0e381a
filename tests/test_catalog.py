"""Every query of the catalog against its SQL on the smallest tables."""

import pytest

from tests.compare import both, database
from tests.conftest import SMALL
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    ours, theirs, a, b = both(spark, QUERIES[name], ORACLE_SQL[name], SMALL, con)
    assert a == b
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).collect()
