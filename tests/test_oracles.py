"""Every registered query against its SQL, and the entry point."""

import pytest

import __spark_entry__ as entry
import oracle
from askorpus import catalogue

# nothing on either side at this scale: fewer than 31 threads
MAY_BE_EMPTY = {"thread_page_next", "vector_threshold"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    problem = oracle.compare(spark, con, name, sf_dir)
    if name in MAY_BE_EMPTY and problem == "no rows on either side":
        problem = ""
    assert problem == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "prompt"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
