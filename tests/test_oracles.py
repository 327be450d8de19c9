import pytest
from oracle import compare
from skein import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    plans.QUERIES[name](spark, SF).collect()
