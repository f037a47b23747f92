import pytest

from scanloom.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
