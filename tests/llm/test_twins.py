import os
import sys

import pytest
from skein.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
