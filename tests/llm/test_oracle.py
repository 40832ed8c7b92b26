"""Queries that SQL can express, compared with DuckDB."""

from __future__ import annotations

import pytest

from clausework.llm import queries
from tests.llm.helpers import SF_DIR
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SF_DIR), duck(SF_DIR), queries.ORACLE_SQL[name])
    assert ok, message
