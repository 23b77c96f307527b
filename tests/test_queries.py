"""Every registered query with a SQL counterpart gives the same rows as DuckDB."""

import pytest

from lexcorpus.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, folder, name):
    same(registry.queries()[name](spark, folder), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, folder, name):
    assert registry.queries()[name](spark, folder).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
