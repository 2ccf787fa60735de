"""Every query of the core against its SQL over the smallest tables, and those without SQL for rows."""

import os

import pytest

from lexloom.plans.registry import ORACLE, QUERIES
from tests.compare import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        assert differences(spark, QUERIES[name], ORACLE[name]) == ([], [])
    else:
        assert QUERIES[name](spark, DATA).count() > 0


def test_all_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
