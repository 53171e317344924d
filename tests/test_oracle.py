"""Every query that SQL can express, against DuckDB."""

import pytest
from helpers import DATA, oracle, rows

from quire.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(oracle(ORACLES[name]))


def test_known_counts(spark):
    assert QUERIES["search_content"](spark, DATA).count() == 744
    assert QUERIES["matching_sentences"](spark, DATA).count() == 9503
    assert QUERIES["dedupe_first_wins"](spark, DATA).count() == 927
    assert QUERIES["inbook_search"](spark, DATA).count() == 1278


def test_content_search_reads_two_columns_and_shuffles_no_rows_before_the_order(spark):
    plan = QUERIES["search_content"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan.partition("ReadSchema")[2] and "Python" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
