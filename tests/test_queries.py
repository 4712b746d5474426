"""Every query of the core agrees with its SQL on the smallest tables."""

import os

import pytest
from tests.oracle import SF, check

from tidewire.plans import columns, graph, jobs, messages, reports

CASES = [(n, m.QUERIES[n], m.SQL.get(n)) for m in (columns, graph, jobs, messages, reports) for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, query, sql):
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        check(spark, query, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
