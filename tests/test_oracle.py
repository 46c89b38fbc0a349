"""Every query with SQL agrees with DuckDB; every other one runs."""

import pytest

from mentia.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees(spark, root, con, name):
    assert compare(registry.queries()[name](spark, root), con, registry.oracle_sql()[name]) in ("", "no rows")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, root, name):
    assert registry.queries()[name](spark, root).count() >= 0


def test_flagship(spark, root):
    assert registry.flagship(spark, root).columns == ["norm_id", "source", "title", "sentiment", "severity"]
