import pytest

import __spark_entry__
from tenfold.plans import catalogue
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
