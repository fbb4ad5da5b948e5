"""Splitting of hot keys, with thresholds low enough to bite on small data."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import as_set
from whence.plans.skew import bounded_lists, hot_keys, keyed_join, top_rows, with_group_stats

TIGHT = {"part_rows": 10, "every": 1}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; one key is NULL."""
    return spark.range(1000).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") == 1, None).otherwise(F.col("id") % 50).cast("int").alias("k"),
    ).cache()


def test_hot_keys_are_bounded_and_heaviest_first(skewed):
    hot = hot_keys(skewed, ["k"], ["id"], **TIGHT).collect()
    parts = {r["k"]: r["__parts"] for r in hot}
    assert parts[0] == 50
    assert all(p >= 2 for p in parts.values())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join_equals_plain_join(spark, skewed, how):
    small = spark.createDataFrame([(0, "a"), (3, "b"), (None, "n"), (99, "z")], "k int, v string")
    got = keyed_join(skewed, small, ["k"], ["id"], how, **TIGHT)
    right = small.withColumnRenamed("k", "k2")
    want = skewed.join(right, F.col("k").eqNullSafe(F.col("k2")), how)
    assert got.count() == want.count()
    assert as_set(got.select("id")) == as_set(want.select("id"))


def test_hot_key_is_spread_over_parts(skewed):
    hot = hot_keys(skewed, ["k"], ["id"], **TIGHT)
    parts = skewed.join(F.broadcast(hot), "k").select("k", F.pmod(F.xxhash64("id"), "__parts").alias("p"))
    largest = parts.groupBy("k", "p").count().agg(F.max("count")).first()[0]
    assert largest <= 30


def test_group_stats_keep_null_groups(skewed):
    out = with_group_stats(skewed, ["k"], [F.count(F.lit(1)).alias("n")], ["id"], **TIGHT)
    assert out.count() == 1000
    assert out.where("k IS NULL").select("n").first()["n"] == 1
    assert out.where("k = 0").select("n").distinct().collect()[0]["n"] == 500


def test_bounded_lists_split_but_keep_everything(skewed):
    lists = bounded_lists(skewed, ["k"], F.col("id"), ["id"], list_rows=40, **TIGHT)
    zero = lists.where("k = 0").collect()
    assert len(zero) > 1
    assert max(len(r["items"]) for r in zero) < 120
    assert sorted(i for r in zero for i in r["items"]) == list(range(0, 1000, 2))
    assert all(r["items"] == sorted(r["items"]) for r in zero)
    assert lists.where("k = 7").count() == 1


def test_top_rows_prune_before_the_shuffle(skewed):
    top = top_rows(skewed, ["k"], [F.desc("id")], 2)
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {r["id"] for r in top.where("k = 0").collect()} == {998, 996}
