"""Each query of the library equals its SQL on the smallest tables; those without SQL give rows."""

import pytest

from paperloom import catalog
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    f, sql = catalog.ALL[name]
    if sql:
        check(spark, SF, f, sql)
    else:
        assert f(spark, SF).count() > 0
