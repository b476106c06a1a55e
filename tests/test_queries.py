import pytest

from pagemill.plans import queries as plans
from tests.compare import connect, differences

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(plans.QUERIES[name](spark, DIR), con, plans.ORACLES[name]) == ""
