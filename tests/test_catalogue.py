"""Every query against its SQL at the smallest scale; queries without SQL must give rows with a stable schema."""

import pytest

from plait.plans import catalogue

from . import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare.differences(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns == catalogue.QUERIES[name](spark, SF).columns
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
