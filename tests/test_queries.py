"""Every catalogued query against its SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as catalogue
import compare
from lectern.plans import oracle
from lectern.plans import queries as plain_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.views(SF_DIR)


def test_catalogue_and_sql_fit():
    assert set(oracle.oracle_sql()) == set(plain_queries.queries())
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare.differences(catalogue.queries()[name](spark, SF_DIR), duck, SQL[name]) == []


def test_entry(spark):
    rows = catalogue.entry(spark).collect()
    assert [r.label for r in rows] == [0, 1, 2, 3]
    assert all(0 <= r[c] <= 1 for r in rows for c in ("precision", "recall", "f1"))


@pytest.mark.parametrize("name", ["strip_segments", "empty_segments", "drop_empty_segments", "error_rows", "first_error_rows"])
def test_rows_that_can_fail(spark, name):
    assert catalogue.queries()[name](spark, SF_DIR).count() > 0


def test_the_linear_model_on_held_out_rows(spark):
    from lectern.operators import linear
    from lectern.plans import stages

    test = stages.part(spark, SF_DIR, name="test")
    found = linear.predict_linear(test, stages.linear_model(spark, SF_DIR)).collect()
    assert len(found) == test.count()
    # 37 rows at this size; 181 of 184 are right at sf0.01.
    assert sum(r.label == r.prediction for r in found) >= 0.9 * len(found)
