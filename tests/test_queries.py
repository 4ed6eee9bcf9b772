"""Every query of the core library against its SQL, or at least that it runs."""

import pytest

from keyreel.plans import catalogue
from tests.oracle import compare

QUERIES, SQL = catalogue.queries(), catalogue.sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    said = compare(spark, sf_dir, name, QUERIES[name], SQL.get(name))
    assert said == "" or said.startswith("(no SQL)"), said


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
