"""The queries that SQL can express, against it."""

import pytest
from compare import connect, differences
from docweave.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    assert differences(llm.queries()[name](spark, SF), llm.oracle_sql()[name], connect(SF)) == ""
