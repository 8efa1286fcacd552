"""Hand-worked goldens for the column expressions."""

import math

import pytest

from emberspark import schema as S
from emberspark.functions import core, scores
from emberspark.operators import indices as I
from emberspark.operators import quality as Q
from emberspark.operators import scoring as SCO

BAND_DDL = "b04 double, b08 double, b11 double, b12 double, scl int"


def one(df, col):
    return [r[col] for r in df.collect()]


def test_zero_sum_gives_zero_index(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 4)], BAND_DDL)
    out = I.add_all_indices(df).first()
    assert out.ndvi == 0.0 and out.ndmi == 0.0 and out.nbr == 0.0


def test_null_band_propagates_to_class_zero(spark):
    df = spark.createDataFrame([(None, 3000.0, 2000.0, 1500.0, 4)], BAND_DDL)
    out = SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(df))).first()
    assert out.ndvi is None and out.risk_score is None
    assert out.risk_category == 0 and out.category_name == "Unknown"


def test_nan_is_null_at_ingest(spark):
    df = spark.createDataFrame([(float("nan"), 3000.0, 2000.0, 1500.0, 4)], BAND_DDL)
    out = SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(Q.ingest_bands(df)))).first()
    assert out.b04 is None and out.risk_score is None and out.risk_category == 0


def test_index_is_clipped(spark):
    # negative band makes |nd| > 1 before clipping
    df = spark.createDataFrame([(-500.0, 1000.0, 100.0, 100.0, 4)], BAND_DDL)
    assert I.add_ndvi(df).first().ndvi == 1.0


@pytest.mark.parametrize("score,code", [(19.999, 1), (20.0, 2), (40.0, 3), (60.0, 4), (80.0, 5),
                                        (100.0, 5), (-1.0, 1), (150.0, 5), (None, 0)])
def test_class_thresholds(spark, score, code):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(scores.classify("s").alias("c")).first().c == code


def test_class_at_least_matches_classify(spark):
    vals = [(v,) for v in [None, -5.0, 0.0, 19.999, 20.0, 39.9, 40.0, 59.99, 60.0, 79.9, 80.0, 100.0]]
    df = spark.createDataFrame(vals, "s double")
    for k in range(0, 6):
        got = df.select((scores.classify("s") >= k).alias("a"), scores.class_at_least("s", k).alias("b")).collect()
        for r in got:
            assert bool(r.a) == bool(r.b)


def test_three_models_on_one_pixel(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.0)], "ndvi double, ndmi double, nbr double")
    out = df.select(
        scores.calibrated_score(["NDVI", "NDMI", "NBR"]).alias("cal"),
        scores.fast_score("ndvi", "ndmi", "nbr").alias("fast"),
        scores.simple_score("ndvi", "ndmi").alias("simple"),
        scores.simple_score("ndvi").alias("simple_ndvi"),
        scores.vegetation_health("ndvi").alias("h"),
        scores.moisture_score("ndmi").alias("m"),
        scores.burn_resistance("nbr").alias("b")).first()
    assert out.cal == pytest.approx(45.0)
    assert out.fast == pytest.approx(75.0)
    assert out.simple == pytest.approx(32.5)
    assert out.simple_ndvi == pytest.approx(25.0)
    assert (out.h, out.m, out.b) == (pytest.approx(200 / 3), pytest.approx(50.0), pytest.approx(50.0))


def test_partial_index_set_renormalises(spark):
    df = spark.createDataFrame([(0.5,)], "ndvi double")
    out = df.select(scores.calibrated_score(["NDVI"]).alias("s")).first().s
    assert out == pytest.approx(100 - 200 / 3)


def test_custom_weights_are_normalised(spark):
    w = scores.normalize_weights({"NDVI": 2, "NDMI": 1, "NBR": 1})
    assert w == {"NDVI": 0.5, "NDMI": 0.25, "NBR": 0.25}
    df = spark.createDataFrame([(0.5, 0.2, 0.0)], "ndvi double, ndmi double, nbr double")
    out = df.select(scores.calibrated_score(["NDVI", "NDMI", "NBR"], {"NDVI": 2, "NDMI": 1, "NBR": 1}).alias("s"))
    assert out.first().s == pytest.approx(0.5 * (100 - 200 / 3) + 0.25 * 50 + 0.25 * 50)


def test_weight_errors():
    with pytest.raises(ValueError):
        scores.normalize_weights({"NDVI": 0.0})
    with pytest.raises(ValueError):
        scores.calibrated_score([])


def test_no_weighted_index_scores_zero(spark):
    df = spark.createDataFrame([(0.5,)], "ndvi double")
    out = df.select(scores.calibrated_score(["NDVI"], {"NDMI": 1.0}).alias("s")).first().s
    assert out == 0.0


def test_missing_band_in_direct_call_raises(spark):
    df = spark.createDataFrame([(1.0,)], "b04 double")
    with pytest.raises(ValueError):
        I.add_ndvi(df)
    assert I.available_indices(df) == []


def test_cloud_mask_codes(spark):
    rows = [(1000.0, 3000.0, 2000.0, 1500.0, code) for code in range(12)] + [(1000.0, 3000.0, 2000.0, 1500.0, None)]
    df = Q.apply_cloud_mask(spark.createDataFrame(rows, BAND_DDL))
    got = {r.scl: r.b04 for r in df.collect()}
    for code in range(12):
        assert (got[code] is None) == (code in S.MASKED_SCL_CODES)
    assert got[None] == 1000.0


def test_cloud_mask_without_scl_is_identity(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "b04 double, b08 double")
    assert Q.apply_cloud_mask(df).collect() == df.collect()


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,), (0.5,)], "x double")
    assert one(df.select(core.clip("x", -1, 1).alias("c")), "c") == [None, 1.0, -1.0, 0.5]


def test_fast_index_epsilon(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 4)], BAND_DDL)
    out = I.add_fast_indices(df).first()
    assert out.ndvi_fast == 0.0


def test_quality_split(spark):
    from datetime import date
    rows = [(1, date(2024, 1, 1), "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", 50.0),
            (2, date(2024, 1, 1), "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", None),
            (3, date(2024, 1, 1), "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", 101.0),
            (4, date(2024, 1, 1), "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", float("nan")),
            (5, None, "POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))", 10.0)]
    df = spark.createDataFrame(rows, "id long, assessment_date date, geom_wkt string, risk_score double")
    good, bad = Q.split_valid(df)
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert {r.id: r.reason for r in bad.collect()} == {
        3: "risk_score outside 0..100", 4: "risk_score is NaN", 5: "assessment_date is null"}
    with pytest.raises(Exception):
        Q.enforce_valid(df).collect()


def test_category_names_and_colours(spark):
    df = spark.createDataFrame([(c,) for c in range(7)], "c int")
    names = one(df.select(scores.category_name("c").alias("n")), "n")
    assert names == ["Unknown", "Very Low", "Low", "Moderate", "High", "Very High", "Unknown"]
    from emberspark.functions import colour as C
    rgba = df.select(*[v.alias(k) for k, v in C.category_rgba("c").items()]).collect()
    assert tuple(rgba[0]) == (0, 0, 0, 0)
    assert tuple(rgba[5]) == (0xDC, 0x14, 0x3C, 255)


def test_palette_bucket(spark):
    from emberspark.functions import colour as C
    df = spark.createDataFrame([(None,), (0.0,), (50.0,), (100.0,), (120.0,)], "s double")
    got = one(df.select(C.palette_bucket("s", 0, 100).alias("b")), "b")
    assert got == [None, 0, 128, 255, 255]


def test_wkt_roundtrip(spark):
    from emberspark.functions import geo as G
    df = spark.createDataFrame([(150.1, -33.9, 150.2, -33.8)], "x0 double, y0 double, x1 double, y1 double")
    w = df.select(G.box_wkt("x0", "y0", "x1", "y1").alias("w")).first().w
    assert w == "POLYGON((150.1 -33.9, 150.2 -33.9, 150.2 -33.8, 150.1 -33.8, 150.1 -33.9))"
    r = df.select(G.box_wkt("x0", "y0", "x1", "y1").alias("w")).select(G.wkt_ring("w").alias("r"))
    bb = r.select(*[v.alias(k) for k, v in G.ring_bbox("r").items()]).first()
    assert (bb.xmin, bb.ymin, bb.xmax, bb.ymax) == (150.1, -33.9, 150.2, -33.8)


def test_degree_box_area(spark):
    from emberspark.functions import geo as G
    df = spark.createDataFrame([S.STUDY_AREA], "a double, b double, c double, d double")
    ha = df.select(G.degree_box_hectares("a", "b", "c", "d").alias("h")).first().h
    assert ha == pytest.approx(492840.0)
    assert not math.isnan(ha)


def test_weights_from_a_table(spark):
    from emberspark.operators.scoring import add_calibrated_score_by
    px = spark.createDataFrame([(1, 0.5, 0.2, 0.0), (2, 0.5, 0.2, 0.0), (3, 0.5, 0.2, 0.0)],
                               "region int, ndvi double, ndmi double, nbr double")
    w = spark.createDataFrame([(1, 2.0, 1.0, 1.0), (2, 0.0, 1.0, None)], "region int, w_ndvi double, w_ndmi double, w_nbr double")
    got = {r.region: r.risk_score for r in add_calibrated_score_by(px, w, "region").collect()}
    assert got[1] == pytest.approx(0.5 * (100 - 200 / 3) + 0.25 * 50 + 0.25 * 50)
    assert got[2] == pytest.approx(50.0)          # NDMI only
    assert got[3] == pytest.approx(45.0)          # no row: default weights


def test_empty_assessment_table_gives_one_statistics_row(spark):
    from emberspark.operators import stats as ST
    empty = spark.createDataFrame([], "risk_score double, risk_category string, area_hectares double")
    rows = ST.assessment_statistics(empty).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.total_assessments == 0 and r.very_high_count == 0 and r.low_count == 0
    assert r.avg_risk_score is None and r.min_risk_score is None and r.total_area_hectares is None


def test_series_threshold_is_strict_while_class_four_starts_at_sixty(spark):
    from datetime import date

    from emberspark.operators import stats as ST
    df = spark.createDataFrame([(date(2024, 1, 1), 60.0), (date(2024, 1, 1), 61.0)], "scene_date date, risk_score double")
    r = ST.time_series(df).first()
    assert r.high_risk_area == 50.0
    assert [x.c for x in df.select(scores.classify("risk_score").alias("c")).collect()] == [4, 4]
