import os

import pytest

from strata import catalog
from tests.oracle import connection, rows_of, rows_of_sql

SF = os.environ.get("STRATA_TEST_SF", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(duck, SQL[name])


def test_a_candidate_plans_one_window(spark):
    from strata.catalog import USERS, user_versions
    from strata.operators import views

    plan = views.candidate(user_versions(spark, SF), USERS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # one lag, one lead


def test_gates_read_little(spark):
    """Four scans (of what is written: three) and six exchanges at most."""
    found = catalog.queries()["gate_all"](spark, SF)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= 4 and plan.count("Exchange ") <= 6
