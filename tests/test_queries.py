import pytest
from derivanta.plans.queries import ORACLES, QUERIES
from oracle import compare

MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    n = compare(spark, QUERIES[name], ORACLES[name])
    assert n or name in MAY_BE_EMPTY
