"""Every query with SQL gives what DuckDB gives, over whole tables."""

import pytest
from helpers import rows_of

from lexisift.plans import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    assert len(got.columns) == len(set(got.columns))
