"""Every named query against its SQL."""

import pytest
from compare import connect, differences
from docweave import operations  # noqa: F401
from docweave import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, duck, name):
    assert differences(core.QUERIES[name](spark, SF), core.SQL[name], duck) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
