"""Look-ups with keys that many rows share."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from matchloom.operators.keys import hot_keys, null_safe_lookup, spread_lookup
from matchloom.operators.shared import materialize
from matchloom.operators.store import matched_jobs, unmatched_jobs


@pytest.fixture
def rows(spark):
    """A quarter of 40,000 ids is empty, a quarter NULL, the others differ."""
    i = F.col("id")
    key = F.when(i % 4 == 0, "").when(i % 4 != 1, i.cast("string"))
    return materialize(spark.range(40_000).select(key.alias("job_id"), i.alias("n"), (i % 7).alias("_hash2")), "hot")


@pytest.fixture
def jobs(spark):
    named = spark.range(0, 40_000, 2).select(F.col("id").cast("string").alias("job_id"), F.col("id").alias("title"))
    return named.unionByName(spark.createDataFrame([("", -1), (None, -2)], "job_id string, title long"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_the_plain_lookup(rows, jobs, how):
    got = spread_lookup(rows, jobs, ["job_id"], how)
    want = null_safe_lookup(rows, jobs, ["job_id"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_several_partners_and_repeated_rows(spark):
    left = spark.range(3_000).select(F.lit("a").alias("job_id"), F.lit(1).alias("n")).unionByName(
        spark.range(500).select(F.col("id").cast("string").alias("job_id"), F.lit(2).alias("n")))
    right = spark.createDataFrame([("a", 1), ("a", 2), ("7", 3)], "job_id string, title long")
    got = spread_lookup(left, right, ["job_id"]).groupBy("job_id", "title").count().collect()
    assert {tuple(r) for r in got} == {("a", 1, 3_000), ("a", 2, 3_000), ("7", 3, 1)}


def test_two_keys_are_hot(rows):
    assert hot_keys(rows, ["job_id"]).count() == 2
    assert hot_keys(rows.where(F.col("n") % 4 > 1), ["job_id"]) is None
    assert hot_keys(rows.limit(0), ["job_id"]) is None


def test_no_task_reads_twice_the_median(spark, rows, jobs):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        def sizes(lookup):
            found = lookup(rows, jobs, ["job_id"], "left").groupBy(F.spark_partition_id()).count()
            return [r["count"] for r in found.collect()]

        plain, spread = sizes(null_safe_lookup), sizes(spread_lookup)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(plain) > 2 * median(plain)
    assert max(spread) <= 2 * median(spread)


def test_ids_of_matches_are_distinct_before_they_are_sent(rows, jobs):
    some = rows.where(F.coalesce("job_id", F.lit("")) != "0")
    found = matched_jobs(jobs, some)
    assert found.count() + unmatched_jobs(jobs, some).count() == jobs.count()
    assert {-1, -2} <= {r["title"] for r in found.where("title < 0").collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "LeftSemi" in plan
