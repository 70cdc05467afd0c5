import pytest

from samewise.llm import registry
from tests.compare import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_is_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), connection(SF), registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_one_row_per_row_of_the_table(spark, name):
    table = "pages" if name == "op6_archives" else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert registry.QUERIES[name](spark, SF).count() == rows
