import pytest

from skyweave import queries

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert rows_of(found) == rows_of(want)
