"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_gives_the_result_of_its_sql(spark, con, name):
    got = compare.spark_rows(entry_point.queries()[name](spark, SF))
    want = compare.sql_rows(con, entry_point.oracle_sql()[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert not entry_point.entry(spark).isEmpty()
