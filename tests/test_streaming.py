"""The per-pixel operators run unchanged on a file stream."""

from driver_tables import SF_SMALL
from emberspark.plans import catalogue as CAT
from emberspark.streaming import scoring as STR


def test_stream_scoring_equals_batch(spark, tmp_out):
    src = tmp_out + "/incoming"
    CAT.pixels(spark, SF_SMALL).repartition(3).write.parquet(src)
    stream = STR.score_stream(STR.pixel_stream(spark, src, max_files_per_trigger=1))
    q = STR.start(stream.select("tile_id", "px_row", "px_col", "scene_date", "risk_score", "risk_category"),
                  tmp_out + "/scored", "score_test", checkpoint=tmp_out + "/ckpt", partition_by=["scene_date"])
    q.awaitTermination(120)
    got = spark.read.parquet(tmp_out + "/scored")
    batch = CAT.masked_scored(spark, SF_SMALL).select("tile_id", "px_row", "px_col", "scene_date",
                                                     "risk_score", "risk_category")
    assert got.count() == batch.count()
    assert got.select(*batch.columns).exceptAll(batch).count() == 0
