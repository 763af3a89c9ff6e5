"""Every registered query on the smallest tables, beside its SQL."""

import pytest

import __spark_entry__ as spec
from tools.check_oracles import compare, connect

QUERIES, SQL = spec.queries(), spec.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    assert len(mine) > 0
    if name in SQL:
        assert compare(mine, con.sql(SQL[name]).df()) is None


def test_entry(spark):
    curve = spec.entry(spark).toPandas()
    assert len(curve) == 100
