"""Every core query against its SQL, and those without SQL for rows."""

import pytest
from conftest import DATA
from oracle import assert_same

from quillspark.plans import converter_queries, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLES:
        assert_same(df, DATA, queries.ORACLES[name])
    else:
        assert df.count() > 0
