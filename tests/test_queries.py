"""Every registered query on the smallest tables: equal to its SQL twin, or non-empty without one."""

import pytest

from compare import compare, connect
from typetrace.plans import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    ok, message = compare(spark, con, REGISTRY[name], SF)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
