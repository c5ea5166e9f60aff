import pytest

from beamframe import catalogue
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_no_query_without_a_table():
    assert "q_pose_graph" not in catalogue.queries()  # its solver has a test on a fixture


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
