"""Each query equals its SQL on the smallest given tables. The four that write every invoice and day out are left to
the larger check run (`python -m checks.compare FOLDER`) and to the brute-force tests."""

import pytest

from checks.compare import compare, connect
from checks.oracle import SQL
from checks.queries import JOBS

SMALL = "/root/testdata/sf0.001"
DENSE = {"fx_daily_detail_by_month", "fx_invoice_series_extremes", "fx_daily_detail_digest", "fx_invoice_series_digest"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(SQL) == set(JOBS)


@pytest.mark.parametrize("name", sorted(set(JOBS) - DENSE))
def test_query_equals_its_sql(spark, con, name):
    rows, problems = compare(spark, con, SMALL, name)
    assert problems == [] and rows > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).limit(1).count() == 1
    assert set(JOBS) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql()) <= set(driver.queries())
