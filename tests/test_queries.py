"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from slicewise.plans import registry
from tests.conftest import SMALL
from tests.helpers import rows_of, sql_rows

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows_of(QUERIES[name](spark, SMALL))
    if name in ORACLES:
        assert got == sql_rows(duck, ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
