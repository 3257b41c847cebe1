"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, differences

from rankmill import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in SQL:
        assert differences(spark, con, QUERIES[name], SQL[name], sf_dir)[0] == ""
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0
