"""Every query against its SQL counterpart, with and without broadcast joins."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from gistmill.plans import oracles, queries as catalogue

FOLDER = "/root/testdata/sf0.001"
SQLS = oracles.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(SQLS) == set(catalogue.QUERIES)
    assert set(SQLS) <= set(entry.oracle_sql()) and set(SQLS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query(spark, connection, name):
    assert compare(spark, connection, FOLDER, entry.queries()[name], SQLS[name]) is None


@pytest.mark.parametrize("name", ["digest_document", "scan_class_by_corpus", "update_digest", "attention_list"])
def test_query_with_shuffled_joins(spark, connection, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(spark, connection, FOLDER, entry.queries()[name], SQLS[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and sum(r.up_to_date + r.outdated + r.new for r in rows) > 0
