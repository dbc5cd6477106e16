"""Every query that SQL can state, against its SQL on the smallest tables."""

import pytest
from compare import compare, duck

from stforecast.llm import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) is None


def test_every_operator_has_its_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
