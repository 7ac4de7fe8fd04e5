"""Every query with SQL against it, and every query over empty tables."""

import pytest

import check_oracles
from musterline.llm import queries  # noqa: F401  (registration)
from musterline.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "embeddings", "conversations")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    good, note = check_oracles.compare(spark, check_oracles.duck(SMALL), name, SMALL)
    assert good, note


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for table in TABLES:
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(
            f"{folder}/{table}.parquet"
        )
    return folder


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_empty_results(spark, empty_tables, name):
    assert QUERIES[name](spark, empty_tables).collect() == []
