import pytest

from roadgrid.plans.oracle import ORACLE_SQL
from roadgrid.plans.queries import QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, same_rows, name):
    same_rows(QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


def test_scans_read_only_what_they_use(spark, small):
    plan = QUERIES["char_confidence"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan


def test_best_of_arrays_is_found_once(spark, small):
    """One shuffle, and one search of an image's array, whatever is taken of what it finds."""
    plan = QUERIES["best_detection_array"](spark, small)._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("array_max(") == 1
