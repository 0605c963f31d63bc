"""Queries of the corpus operators against their SQL."""

import pytest

from slicewise.llm import registry
from tests.conftest import SMALL
from tests.helpers import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SMALL)) == sql_rows(duck, registry.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14)) and set(registry.QUERIES) < names and "pipeline" in names
