"""The same results when no side is small enough to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.operators import curate, monitor
from answerloom.plans import inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def results(spark):
    docs = inputs.table(spark, SF, "documents").select("doc_id", "source", "text")
    rng = random.Random(4)
    skewed = spark.createDataFrame([(rng.choice("aaab"), rng.lognormvariate(2, 2)) for _ in range(500)], "g string, v double")
    yield curate.deduplicate(docs, F.col("text"), "doc_id").select("doc_id")
    yield curate.split_stratified(docs, "doc_id", F.col("source")).select("doc_id", "split")
    yield monitor.exact_percentiles(skewed, ["g"], "v", [0.5, 0.95])


def test_shuffle_joins_give_the_same(spark, no_broadcast):
    slow = [rows_of(df) for df in results(spark)]
    plan = curate.deduplicate(inputs.table(spark, SF, "documents"), F.col("text"), "doc_id")._jdf.queryExecution()
    assert "BroadcastHashJoin" not in plan.executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert [rows_of(df) for df in results(spark)] == slow
