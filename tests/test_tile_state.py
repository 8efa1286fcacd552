"""Tile batches from stored partial aggregates."""

import time

from pyspark.sql import functions as F

from emberspark.operators import indices as I
from emberspark.operators import scoring as SCO
from emberspark.plans import tile_state as TS


def tiles(spark, lo, hi):
    n = F.col("id")
    return spark.range(lo * 50, hi * 50).select(F.floor(n / 50).alias("tile_id"), (n % 900 + 100.0).alias("b04"), (n * 7 % 4000 + 300.0).alias("b08"),
                                                (n % 31 * 90 + 800.0).alias("b11"), F.when(n % 11 > 0, n % 17 * 90 + 600.0).alias("b12"))


def plain(df, only=None):
    scored = SCO.add_calibrated_score(I.add_all_indices(df, only))
    return {(str(r.tile_id), r.n, r.m) for r in scored.groupBy("tile_id").agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 2).alias("m")).collect()}


def found(spark, path, state, only=None):
    return {(r.tile, r.pixels, r.tile_mean_risk) for r in TS.tile_totals(spark, path, state, only).collect()}


def test_new_changed_and_deleted_files(spark, tmp_out):
    path, state = tmp_out + "/tiles", tmp_out + "/state"
    tiles(spark, 0, 3).coalesce(1).write.parquet(path + "/a")
    assert TS.update(spark, path, state) == 1 and TS.update(spark, path, state) == 0
    tiles(spark, 3, 7).repartition(2).write.parquet(path + "/b")
    assert TS.update(spark, path, state) == 2
    assert found(spark, path, state) == plain(tiles(spark, 0, 7))
    time.sleep(1.1)
    tiles(spark, 0, 2).coalesce(1).write.mode("overwrite").parquet(path + "/a")  # written anew, one tile less
    assert TS.update(spark, path, state) == 1
    assert found(spark, path, state) == plain(tiles(spark, 0, 2).union(tiles(spark, 3, 7)))
    report = TS.batches(TS.tile_totals(spark, path, state), 4).orderBy("batch_id").collect()
    assert [r.tiles for r in report] == [4, 2]


def test_the_index_list_is_another_model(spark, tmp_out):
    path, state = tmp_out + "/tiles", tmp_out + "/state"
    tiles(spark, 0, 4).coalesce(1).write.parquet(path)
    assert TS.update(spark, path, state) == 1
    assert TS.update(spark, path, state, ["NDVI"]) == 1 and TS.update(spark, path, state, ["NDVI"]) == 0
    assert found(spark, path, state, ["NDVI"]) == plain(tiles(spark, 0, 4), ["NDVI"])
    assert found(spark, path, state) == plain(tiles(spark, 0, 4)) != found(spark, path, state, ["NDVI"])


def test_no_tiles(spark, tmp_out):
    tiles(spark, 0, 0).write.parquet(tmp_out + "/tiles")
    TS.update(spark, tmp_out + "/tiles", tmp_out + "/state")
    assert found(spark, tmp_out + "/tiles", tmp_out + "/state") == set()
