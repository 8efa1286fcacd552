"""Distributed global rank and the systematic marker sample."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberspark.operators import ranking as R


def test_global_row_number_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("v"))
    got = R.global_row_number(df, ["k"], num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("k")) - 1)
    j = got.join(ref, "k")
    assert j.where(F.col("row_idx") != F.col("rn")).count() == 0
    assert j.count() == 5000


def _sample_count(spark, n):
    df = spark.range(0, n).select(F.floor(F.col("id") / 10).alias("px_row"), (F.col("id") % 10).alias("px_col"))
    return R.systematic_sample(df, ["px_row", "px_col"]).count()


def test_marker_counts_follow_the_step_rule(spark):
    assert _sample_count(spark, 39) == 39      # step 1
    assert _sample_count(spark, 40) == 20      # step 2
    assert _sample_count(spark, 5) == 5
    assert _sample_count(spark, 1000) == 20


def test_batch_assignment(spark):
    tiles = spark.range(0, 10).select((F.col("id") * 3).alias("tile_id"))
    got = {r.tile_id: (r.tile_ordinal, r.batch_id) for r in R.batch_assignment(tiles, size=4).collect()}
    assert got[0] == (0, 0) and got[9] == (3, 0) and got[12] == (4, 1) and got[27] == (9, 2)


def test_sample_per_group_equals_separate_samples(spark):
    df = spark.range(0, 3000).select(
        (F.col("id") % 3).alias("scene"), F.floor(F.col("id") / 30).alias("px_row"), (F.col("id") % 10).alias("px_col"))
    sizes = {0: 39, 1: 40, 2: 1000}
    parts = [df.where((F.col("scene") == s) & (F.col("px_row") * 10 + F.col("px_col") < n)) for s, n in sizes.items()]
    from functools import reduce
    data = reduce(lambda a, b: a.unionByName(b), parts)
    got = R.systematic_sample(data, ["px_row", "px_col"], by=["scene"])
    per = {r.scene: r.n for r in got.groupBy("scene").agg(F.count("*").alias("n")).collect()}
    for s, p in zip(sizes, parts):
        assert per[s] == R.systematic_sample(p, ["px_row", "px_col"]).count()
