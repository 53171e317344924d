import pytest
from helpers import DATA, oracle, rows

from quire.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(oracle(ORACLES[name]))


def test_ten_operators():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
