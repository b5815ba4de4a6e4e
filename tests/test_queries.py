"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from postloom.plans.registry import registered
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
OWN = registered()  # queries of the llm subpackage have their tests in tests/llm
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_only_mllib_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == {"train_logreg", "train_svm", "benchmark_models", "fit_and_tune"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(QUERIES[name](spark, FOLDER), duck, ORACLE[name])
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
