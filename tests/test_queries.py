import pytest
from oracle import DATA, same

from chronoloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    assert same(QUERIES[name](spark, DATA), ORACLE_SQL[name]) > 0
