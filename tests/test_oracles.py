"""Every registered query on the smallest tables, against its SQL."""

import pytest

import check_oracles
from musterline.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_oracles.duck(SMALL)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, connection, name):
    good, note = check_oracles.compare(spark, connection, name, SMALL)
    assert good, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
