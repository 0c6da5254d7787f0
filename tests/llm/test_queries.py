"""Queries against their SQL, and what every one of them promises."""

import pytest

from strata.llm import queries
from tests.oracle import connection, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(connection(SF), queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
