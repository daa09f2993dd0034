"""All registered queries of the plans against their SQL, or run where SQL cannot express them."""

import pytest
from compare import differences, duck

import __spark_entry__
from synapta.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == []


#: 5,000 folds of 404 fits each: minutes on a few cores. Its rows are checked with fewer repeats in test_operators, its numbers in test_crossval.
LONG = {"permutation_null"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["subid", "valid_num", "valid_subject"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
