"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from corvane.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def link():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_parity(spark, link, name):
    assert compare(spark, link, SF, name).endswith("ok")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(all_sql()) <= set(all_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
