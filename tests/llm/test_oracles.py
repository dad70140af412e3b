import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from derivanta.llm.queries import ORACLES, QUERIES
from oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name])
