"""Hot keys must not change any result."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.operators.dedup import dense_ids, get_or_create_ids
from marketlens.operators.skew import earlier_rows, hot_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), rng.randrange(50)) for i in range(400)]
    return spark.createDataFrame(rows, "seq long, k string, v long").cache()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_hot_join_equals_plain_join(spark, skewed, rows_of, how):
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("b", 3), ("zz", 4)], "k string, w int")
    plain = skewed.join(right, ["k"], how)
    salted = hot_join(skewed, right, ["k"], how, hot_rows=30, salts=8)
    assert rows_of(salted, *sorted(plain.columns)) == rows_of(plain, *sorted(plain.columns))


def test_hot_join_splits_the_hot_key(spark, skewed):
    right = spark.createDataFrame([("hot", 1)], "k string, w int")
    plan = hot_join(skewed, right, ["k"], "inner", hot_rows=30, salts=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "explode" in plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_join_cuts_a_key_into_parts_by_its_count(spark, rows_of, how):
    left = spark.range(3000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2)], "k string, w int")
    joined = hot_join(left, right, ["k"], how, hot_rows=10, salts=4)
    assert rows_of(joined, "seq", "k", "w") == rows_of(left.join(right, ["k"], how), "seq", "k", "w")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "ceil" in plan.lower()  # 2,000 rows at 10 a part: 200 parts, not 4


def test_hot_join_skips_map_columns(spark):
    left = spark.createDataFrame([(1, {"a": "b"})], "k int, m map<string,string>")
    right = spark.createDataFrame([(1, 2)], "k int, w int")
    assert hot_join(left, right, ["k"]).count() == 1


@pytest.mark.parametrize("block", [1, 3, 50, 1000])
def test_earlier_rows_equals_one_window_per_key(skewed, rows_of, block):
    before = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("k").orderBy("seq")
    expected = skewed.select(
        "*",
        F.max("v").over(before).alias("m"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"),
        F.count("v").over(before).alias("n"),
        F.lag("v").over(order).alias("p"),
    )
    values = {"m": ("max", F.col("v")), "s": ("sum", F.col("v")), "n": ("count", F.col("v")), "p": ("previous", F.col("v"))}
    actual = earlier_rows(skewed, ["k"], ["seq"], F.floor(F.col("seq") / block), values)
    assert rows_of(actual) == rows_of(expected)


def test_dense_ids_have_no_gaps(spark):
    values = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("slug"))
    for prefix in (1, 2, 4):
        got = dense_ids(values, ["slug"], 5, prefix)
        assert sorted(r.id for r in got.collect()) == list(range(6, 1006))
    same = dense_ids(values, ["slug"], 0, 1).join(dense_ids(values, ["slug"], 0, 3).withColumnRenamed("id", "other"), ["slug"])
    assert same.filter("id <> other").count() == 0


def test_known_ids_stay_and_read_only_gives_zero(spark, rows_of):
    known = spark.createDataFrame([(7, "a")], "id bigint, slug string")
    seen = spark.createDataFrame([("a",), ("b",), ("b",)], "slug string")
    assert rows_of(get_or_create_ids(known, seen, ["slug"])) == [(7, "a"), (8, "b")]
    assert rows_of(get_or_create_ids(known, seen, ["slug"], read_only=True)) == [(0, "b"), (7, "a")]
