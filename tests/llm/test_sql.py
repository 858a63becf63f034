"""Corpus queries against their SQL, over the smallest tables."""

import pytest

from duck import compare, connect
from evigrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF)
