"""Pixels of a study area against the plain test on coordinates."""

import random

import pytest

from driver_tables import SF_SMALL
from emberspark.operators import area as A
from emberspark.plans import catalogue as CAT


def scenes(spark):
    rows = [(1, 20, 10, 0.5, 0.0, 100.0, 0.0, -0.25, 50.0), (2, 20, 10, 0.1, 0.0, 104.0, 0.0, -0.1, 49.0),
            (3, 20, 10, 0.3, 0.2, 101.0, -0.1, -0.3, 49.5), (4, 20, 10, 0.5, 0.0, 300.0, 0.0, -0.25, 50.0)]
    return rows, spark.createDataFrame(rows, "tile_id long, width long, height long, a double, b double, c double, d double, e double, f double")


def test_area_matches_a_plain_filter(spark):
    rows, df = scenes(spark)
    pixels = [(t, r, c) for t, w, h, *_ in rows for r in range(h) for c in range(w)] + [(9, 0, 0)]
    px = spark.createDataFrame(pixels, "tile_id long, px_row long, px_col long")
    rng = random.Random(2)
    boxes = [(100.0, 48.0, 103.0, 50.0), (104.0, 48.5, 104.0, 49.0), (0.0, 0.0, 1.0, 1.0)]
    boxes += [(x, y, x + rng.uniform(0, 4), y + rng.uniform(0, 2)) for x, y in ((rng.uniform(99, 108), rng.uniform(46, 50)) for _ in range(3))]
    for box in boxes:
        want = set()
        for t, _, _, a, b, c, d, e, f in rows:
            for _, r, k in (p for p in pixels if p[0] == t):
                x, y = a * k + b * r + c, d * k + e * r + f
                if box[0] <= x <= box[2] and box[1] <= y <= box[3]:
                    want.add((t, r, k, x, y))
        assert {tuple(r) for r in A.pixels_in_area(px, df, box).collect()} == want, box


def test_rows_and_columns_reach_the_scan(spark):
    df = CAT.q_date_series_area(spark, SF_SMALL)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(l_orderkey" in plan and "LessThanOrEqual(l_orderkey" in plan and "BroadcastHashJoin" in plan


def test_a_flat_transform_is_refused(spark):
    _, df = scenes(spark)
    with pytest.raises(Exception, match="cannot be inverted"):
        A.pixel_ranges(df.selectExpr("tile_id", "width", "height", "0D AS a", "b", "c", "d", "e", "f"), (0, 0, 1, 1)).collect()
