"""Joins past the broadcast limits: the large side is evaluated once, and its hot keys
are found from one column of it."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from topictone.config import JoinConfig
from topictone.operators.joins import attach, join_stored, store_with_hot_keys
from topictone.operators.nb import NBModel, fit_nb

TINY = JoinConfig(0, 0)


def counted(spark, df, col):
    """``df`` whose column counts how often one of its values is computed."""
    seen = spark.sparkContext.accumulator(0)

    def value(v):
        seen.add(1)
        return v

    return df.withColumn(col, F.udf(value, StringType())(col)), seen


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_the_large_side_is_computed_once(spark, how, null_safe):
    rows = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 40}", str(i)) for i in range(3000)]
    big = spark.createDataFrame(rows, "key string, v string").repartition(5)
    small = spark.createDataFrame([("hot", 1), (None, 2), ("k3", 3), ("k3", 4)], "key string, w int")
    want = attach(big, small, ["key"], how=how, null_safe=null_safe)
    once, seen = counted(spark, big, "v")
    got = attach(once, small, ["key"], how=how, null_safe=null_safe, cfg=TINY)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert got.columns == want.columns and got.count() == want.count() and seen.value == 3000


def test_hot_keys_are_named_and_bounded(spark):
    rows = [("a" if i % 2 else "b" if i % 10 == 0 else f"r{i}",) for i in range(8000)]
    stored = store_with_hot_keys(spark.createDataFrame(rows, "key string").repartition(6), ["key"])
    splits = {r["k"]: r["n"] for r in stored.table.select(F.col("key").alias("k"), "__tt_key_hash").distinct()
              .join(stored.hot, "__tt_key_hash").select("k", F.col("__tt_nsalt").alias("n")).collect()}
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert splits == {"a": -(-p // 2)} and stored.hot.count() <= 2 * p


def test_equal_rows_of_a_hot_key_are_spread(spark):
    """5,000 equal rows: nothing but their place tells them apart (AQE off)."""
    big = spark.range(5000).select(F.lit("hot").alias("key"), F.lit(1).alias("v")).repartition(3)
    small = spark.createDataFrame([("hot", 7)], "key string, w int")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = join_stored(store_with_hot_keys(big, ["key"], small), small)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 5000 and len(sizes) >= 3 and max(sizes) < 3500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_keys_of_other_types(spark):
    """Both sides are hashed in the type in which they are compared."""
    big = spark.range(900).select((F.col("id") % 3).cast("int").alias("key"), "id")
    small = spark.createDataFrame([(0, "x"), (2, "y"), (9, "z")], "key bigint, w string")
    got = attach(big, small, ["key"], cfg=TINY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, attach(big, small, ["key"]).collect())) and got.count() == 600


def test_empty_sides(spark):
    big = spark.createDataFrame([], "key string, v int")
    small = spark.createDataFrame([("a", 1)], "key string, w int")
    assert attach(big, small, ["key"], cfg=TINY).collect() == []
    some = spark.createDataFrame([("a", 1)], "key string, v int")
    assert attach(some, small.limit(0), ["key"], how="left", cfg=TINY).collect() == [("a", 1, None)]


@pytest.mark.parametrize("limits", [JoinConfig(0, 0), JoinConfig(3, 1 << 20)])
def test_texts_are_tokenised_once_past_the_limits(spark, limits):
    train = spark.createDataFrame([(f"good w{i} nice", 1) for i in range(40)] + [(f"bad v{i} awful", 0) for i in range(40)], "text string, label int")
    model = fit_nb(train, "text", "label")
    df = spark.createDataFrame([(i, f"good w{i % 50} bad v{i % 7}") for i in range(300)] + [(900, None), (901, "")], "id bigint, text string")
    want = sorted(map(tuple, model.logits(df, "text", "id").collect()))
    once, seen = counted(spark, df, "text")
    small = NBModel(model.weights, model.prior, model.vocab, join_cfg=limits)
    got = small.logits(once, "text", "id")
    assert sorted(map(tuple, got.collect())) == want and got.count() == 302 and seen.value == 302
