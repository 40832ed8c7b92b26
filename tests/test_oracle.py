"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from clausework.plans import REGISTRY
from tests.oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n, s in REGISTRY.items() if s.sql is not None])
def test_matches_sql(spark, con, name):
    ok, message = compare(REGISTRY[name].run(spark, SF_DIR), con, REGISTRY[name].sql)
    assert ok, message


@pytest.mark.parametrize("name", [n for n, s in REGISTRY.items() if s.sql is None])
def test_runs(spark, name):
    assert REGISTRY[name].run(spark, SF_DIR).count() >= 0
