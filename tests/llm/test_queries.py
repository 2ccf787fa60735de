import os

import pytest

from lexloom.llm.queries import ORACLE, QUERIES
from tests.compare import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        assert differences(spark, QUERIES[name], ORACLE[name]) == ([], [])
    else:
        # No passage of the tables is re-parameterised; test_reparameterised plants some.
        assert QUERIES[name](spark, DATA).count() > (-1 if name == "p9_templates" else 0)
