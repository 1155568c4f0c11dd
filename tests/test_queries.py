"""Every query of the library runs on the smallest tables, and those with SQL give its rows."""

import pytest

from shardloom.plans import catalog
from tests.conftest import DATA, same

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
