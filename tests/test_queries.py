"""Every registered query against its SQL at the smallest scale; the others must give rows."""

import pytest

from millrace.plans import registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert not differences(df, con, registry.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_works():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
