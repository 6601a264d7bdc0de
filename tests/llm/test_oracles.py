"""The operators' queries that SQL expresses equal their SQL."""

import pytest

from paperloom.llm import queries
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    check(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
