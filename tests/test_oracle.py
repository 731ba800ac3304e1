import os

import pytest

from evtspark.plans import catalogue
from tests.conftest import DATA
from tests.oracle import connection, difference


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n.startswith(os.environ.get("ONLY", ""))])
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in catalogue.ORACLE_SQL:
        assert (found := difference(df, con, catalogue.ORACLE_SQL[name])) is None, found
    else:
        assert df.count() > 0
