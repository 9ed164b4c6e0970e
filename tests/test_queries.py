import pytest

from tessera.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, name):
    query = catalog.queries()[name]
    if name in catalog.oracle_sql():
        assert_same(spark, sf, query, catalog.oracle_sql()[name], name)
    else:
        assert query(spark, sf).count() > 0
