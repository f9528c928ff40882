"""Every query of the library against its SQL, or against what is known of its rows."""

from __future__ import annotations

import pytest
from prismlake import registry

from .oracle import FOLDER, compare

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    compare(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_the_flagship_has_the_columns_it_promises(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["group_index", "size", "best_photo"]
    assert set(SQL) <= set(__spark_entry__.queries())
