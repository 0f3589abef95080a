import pytest

import __spark_entry__
from tallyloom.queries import ORACLES, QUERIES
from tests.oracle import compare

WITHOUT_SQL = {"anl_12_clusters"}


def test_every_query_has_a_twin_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, data, name):
    compare(spark, data, QUERIES[name], ORACLES[name])
