"""Every query against its SQL, at the smallest scale."""

import os

import pytest

from kindred import queries

from .oracle import connect, table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    found = queries.queries()[name](spark, DATA).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert len(found.columns) and found.columns.is_unique
        return
    wanted = connect(DATA).execute(sql).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert table(found) == table(wanted)
