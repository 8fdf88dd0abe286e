from __future__ import annotations

import pytest

from plumbline.plans import registry
from tests.conftest import SF, oracle_rows, same_rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_core_query_equals_sql(spark, name):
    assert same_rows(registry.queries()[name](spark, SF).toPandas(), oracle_rows(registry.oracle_sql()[name]))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
