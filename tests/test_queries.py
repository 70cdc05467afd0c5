import pytest

from samewise.plans import registry
from tests.compare import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_is_its_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).columns == ["row", "col", "score"]
