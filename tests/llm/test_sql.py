"""Queries that SQL can express against their SQL."""

import pytest

from leafwire.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    folder = f"{sf_dir}/../sf0.01"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) is None
