"""Every query with SQL gives the rows that DuckDB gives; the others give some."""

import pytest

from cueloom.oracles import ORACLE_SQL
from cueloom.queries import QUERIES
from tests.differential import compare, tables


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    if name in ORACLE_SQL:
        assert compare(spark, sf, QUERIES[name], ORACLE_SQL[name], con) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
