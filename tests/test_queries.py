"""Every registered query against its SQL."""

import pytest

from murmuration.plans import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001") > 0
