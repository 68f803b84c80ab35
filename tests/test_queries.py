"""Every registered query with SQL equals that SQL, whole tables, smallest scale."""

import os

import pytest
from oracle import TESTDATA, compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(name, queries()[name](spark, SF), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["grid_logreg", "platt_scale", "fit_voting", "bootstrap_poisson", "pca_features"])
def test_runs(spark, name):
    df = queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry(spark).count() == 10


def test_sql_only_for_known_queries():
    assert set(oracle_sql()) <= set(queries())
