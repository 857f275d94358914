"""Every catalogue query with SQL beside it gives the same rows as DuckDB."""

import pytest

from lodeframe.plans.catalogue import ORACLE, QUERIES
from tests.support import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
