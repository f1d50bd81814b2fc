"""Every query next to its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from workload.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = queries()[name](spark, small).toPandas()
    assert compare(got, duck.execute(oracle_sql()[name]).df()) == ""


def test_entry(spark, small):
    assert entry(spark).count() > 0
