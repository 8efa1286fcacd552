"""Saved records, prefix sums, the scene catalogue and the order of reports."""

from pyspark.sql import functions as F

from driver_tables import SF_SMALL
from emberspark.operators import ranking as R
from emberspark.plans import assessment as E
from emberspark.plans import catalogue as CAT
from emberspark.plans import oracle_check as OC
from emberspark.sources import sinks as K


def test_different_assessments_of_one_area_and_day_are_both_kept(spark, tmp_out):
    row = ("2024-01-05", "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))")
    df = spark.createDataFrame([(*row, 10.0, None), (*row, 90.0, None), (*row, 90.0, None), (*row, None, 90.0)],
                               "assessment_date string, geom_wkt string, risk_score double, ndvi_mean double").withColumn(
        "assessment_date", F.to_date("assessment_date"))
    assert K.append_assessments(df, tmp_out + "/t").count() == 3
    assert K.append_assessments(df, tmp_out + "/t").count() == 0
    assert sorted((r.risk_score or 0, r.ndvi_mean or 0) for r in spark.read.parquet(tmp_out + "/t").collect()) == [(0, 90.0), (10.0, 0), (90.0, 0)]


def test_masked_tiles_are_returned_with_a_reason(spark, tmp_out):
    scored = spark.createDataFrame([(1, 40.0), (2, None)], "tile_id long, risk_score double")
    ids, bad = E.save_assessment(scored, tmp_out + "/t", assessment_date="2024-01-05", processing_ts="2024-01-05 00:00:00", by=["tile_id"])
    assert ids.count() == 1 and [r.reason for r in bad.collect()] == ["no valid pixel"]


def test_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_ROWS", 4)
    df = spark.range(0, 997).select(F.floor(F.col("id") / 9).alias("r"), (F.col("id") % 9).alias("c"), (F.col("id") % 2).alias("g"))
    got = {(x.sample_rank, x.r * 9 + x.c) for x in R.systematic_sample(df, ["r", "c"], 20).collect()}
    assert got == {(k, k * 49) for k in range(21)}
    by = R.systematic_sample(df, ["r", "c"], 20, by=["g"]).collect()
    for g in (0, 1):
        ids = [i for i in range(997) if i % 2 == g]
        step = max(1, len(ids) // 20)
        assert sorted(x.r * 9 + x.c for x in by if x.g == g) == ids[::step]


def test_pixels_meet_scenes_without_a_shuffle(spark):
    plan = CAT.q_pixel_affine(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_order_is_compared():
    assert OC.in_order("SELECT a FROM t ORDER BY a DESC, b") and not OC.in_order("SELECT row_number() OVER (ORDER BY a) FROM t")
    assert OC.same_order((["a"], [(1,), (2,)]), (["a"], [(1,), (2,)])) and not OC.same_order((["a"], [(2,), (1,)]), (["a"], [(1,), (2,)]))
