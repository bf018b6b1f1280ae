"""Every query of the subpackage runs on the smallest tables and equals its SQL, where it has one."""

import pytest
from oracle_check import FOLDER, connect, same

from slotlake.llm import queries

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.CHECKED:
        assert name not in queries.ORACLE and queries.CHECKED[name] in queries.ORACLE
        queries.QUERIES[name](spark, str(FOLDER)).write.format("noop").mode("overwrite").save()
    else:
        assert same(spark, con, queries.QUERIES[name], queries.ORACLE[name])
