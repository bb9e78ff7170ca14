"""Contents of files that are not due leave in the scan."""

import contextlib

import pytest
from pyspark.sql import functions as F

from gistmill.operators.key_filter import FilterSize, filter_words, may_be_key
from gistmill.plans import jobs, testbed
from gistmill.schemas import KEY
from gistmill.session import Staging

FOLDER = "/root/testdata/sf0.001"


def keyed(spark, numbers):
    return spark.range(*numbers).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("corpus_id"), F.col("id").cast("string").alias("relative_path")
    )


@pytest.mark.parametrize("n", [1, 30, 5000])
def test_no_key_is_lost_and_few_others_pass(spark, n):
    keys, others, size = keyed(spark, (n,)), keyed(spark, (10**6, 10**6 + 40_000)), FilterSize.of(n)
    words = filter_words(keys.union(keys), size)
    assert len(words.first().words) == size.bits // 64
    assert keys.where(may_be_key(words, size)).count() == n
    assert others.where(may_be_key(words, size)).count() < 0.03 * 40_000


def test_bounded_size(spark):
    size = FilterSize.of(10**9)
    assert size.bits == 1 << 28 and size.probes == 1
    small, keys = FilterSize.of(5000, most_bits=1 << 12), keyed(spark, (5000,))
    assert small.bits == 1 << 12 and keys.where(may_be_key(filter_words(keys, small), small)).count() == 5000


def test_no_keys_and_null_keys(spark):
    size = FilterSize.of(0)
    nulls = spark.createDataFrame([("a", None, 1), (None, "b", 2), (None, None, 3)], "corpus_id string, relative_path string, place int")
    rows = nulls.unionByName(spark.createDataFrame([("a", "b", 4)], nulls.schema))
    for keys in (rows.limit(0), nulls):
        assert rows.where(may_be_key(filter_words(keys, size), size)).count() == 0
    assert [r.place for r in rows.where(may_be_key(filter_words(rows, size), size)).collect()] == [4]


def test_contents_are_filtered_before_they_move(spark):
    files = testbed.files(spark, FOLDER)
    with contextlib.closing(Staging(spark)) as staging:
        changes = staging.keep(files.select(*KEY, (F.abs(F.hash("relative_path")) % 20 == 0).alias("due")), "changes")
        wanted = changes.where("due").count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            near = jobs.near_due(files, changes, staging)
            due = jobs.due_only(near, changes, False).select(*KEY, "content")
            lines = due._jdf.queryExecution().executedPlan().toString().splitlines()
            found = due.collect()
            plan = due._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert wanted <= near.count() <= wanted + 5 and len(found) == wanted
        assert all(r.content is not None for r in found)
        # the first of the join's two sides is that of the contents
        of_contents, of_keys = [i for i, line in enumerate(lines) if "- Exchange hashpartitioning(corpus_id" in line]
        assert of_contents < next(i for i, line in enumerate(lines) if "getbit" in line) < of_keys
        # the words are read once, whatever the number of probes
        assert plan.count("- ReusedSubquery") >= FilterSize.of(wanted).probes - 1
