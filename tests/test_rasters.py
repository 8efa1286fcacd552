"""The array file source and sink."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberspark.sources import rasters as R


def files(folder):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".npy"))


def raster(spark, n=4000, width=50):
    return spark.range(n).select((F.col("id") % 3).alias("t"), F.floor(F.col("id") / width).alias("px_row"), (F.col("id") % width).alias("px_col"),
                                 F.when(F.col("id") % 7 > 0, F.col("id") * 1.5).alias("v"), (F.col("id") * 2.0).alias("w"))


def test_sparse_tiles_keep_their_pixels(spark, tmp_out):
    df = raster(spark)
    R.write_rasters(df, tmp_out + "/r", ["v", "w"], "t", 16)
    back = R.read_rasters(spark, tmp_out + "/r", ["v", "w"])
    assert back.columns == ["tile", "px_row", "px_col", "v", "w"] and back.count() == 4000
    assert back.exceptAll(df.select(F.col("t").cast("string"), "px_row", "px_col", "v", "w")).count() == 0
    assert all(f.endswith(".list.npy") for f in files(tmp_out))


def test_dense_chunks_repeats_and_several_writes(spark, tmp_out):
    df = raster(spark, 1000, 20)
    R.write_rasters(df, tmp_out, ["v"], None, 10)
    assert len(files(tmp_out)) == 10 and not any(f.endswith(".list.npy") for f in files(tmp_out))
    R.write_rasters(df.where("px_row < 2").union(df.where("px_row < 1")), tmp_out, ["v"], None, 10)
    assert R.read_rasters(spark, tmp_out, ["v"]).count() == 1000 + 60


@pytest.mark.parametrize("size", [700, 1 << 20])
@pytest.mark.parametrize("order", ["C", "F"])
def test_filters_read_only_what_is_asked_for(spark, tmp_out, order, size):
    rng = np.random.default_rng(1)
    arrays = {"a_r100_c200": rng.random((37, 23)), "b": rng.random((20, 11)), "tile=x y/c_r10_c0": rng.random((9, 30))}
    for name, arr in arrays.items():
        os.makedirs(os.path.dirname(f"{tmp_out}/{name}"), exist_ok=True)
        np.save(f"{tmp_out}/{name}.npy", np.asarray(arr, order=order))
    df = R.read_rasters(spark, tmp_out, ["v"], partition_bytes=size)
    pixels = {}
    for (tile, r0, c0), arr in zip((("a", 100, 200), ("b", 0, 0), ("x y", 10, 0)), arrays.values()):
        pixels |= {(tile, r0 + i, c0 + j): float(arr[i, j]) for i in range(arr.shape[0]) for j in range(arr.shape[1])}
    for test, keep in (("true", lambda t, r, c: True), ("tile = 'a' AND px_row > 110 AND px_col <= 205", lambda t, r, c: t == "a" and r > 110 and c <= 205),
                       ("tile IN ('b', 'x y') AND px_row >= 12 AND px_row < 15", lambda t, r, c: t != "a" and 12 <= r < 15),
                       ("px_row = 12 AND px_col = 7", lambda t, r, c: (r, c) == (12, 7)), ("px_row < 0", lambda t, r, c: False),
                       ("v > 0.5 AND px_col >= 5", lambda t, r, c: c >= 5 and pixels[t, r, c] > 0.5)):
        got = {(r.tile, r.px_row, r.px_col): r.v for r in df.where(test).collect()}
        assert got == {k: v for k, v in pixels.items() if keep(*k)}, test
    plan = df.where("tile = 'a' AND px_row > 110")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark to filter
    if size == 700:
        assert df.rdd.getNumPartitions() >= 10  # one file is read by several tasks


def test_pruned_files_are_not_opened():
    schema = R.RasterSource({"bands": "v"}).schema()
    reader = R.RasterReader(schema, {"path": "/nowhere"})
    left = list(reader.pushFilters([R.EqualTo(("tile",), "a"), R.GreaterThanOrEqual(("px_row",), 50), R.LessThan(("px_row",), 60),
                                    R.GreaterThan(("v",), 0.5)]))
    assert [f.attribute for f in left] == [("v",)]
    names = [R._File("x_r0_c0.npy", 1, "a", (0, 50), (0, 9)), R._File("x_r50_c0.npy", 1, "a", (50, 99), (0, 9)),
             R._File("x_r60_c0.npy", 1, "a", None, None), R._File("x_r0_c0.npy", 1, "a", None, None), R._File("y_r50_c0.npy", 1, "b", (50, 99), (0, 9))]
    assert [reader.bounds.may_hold(f) for f in names] == [False, True, False, True, False]


def test_a_failed_write_leaves_nothing_to_read(spark, tmp_out):
    R.write_rasters(raster(spark, 100, 10), tmp_out, ["v"], None, 5)
    boom = F.when(F.col("px_row") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("w"))
    with pytest.raises(Exception, match="boom"):
        R.write_rasters(raster(spark, 100, 10).withColumn("v", boom), tmp_out, ["v"], None, 5)
    with pytest.raises(Exception, match="no place in a raster"):
        R.write_rasters(raster(spark, 100, 10).withColumn("px_row", F.when(F.col("px_row") > 3, F.col("px_row"))), tmp_out, ["v"], None, 5)
    assert R.read_rasters(spark, tmp_out, ["v"]).count() == 100
    manifests = [f for f in os.listdir(tmp_out) if f.startswith("_manifest-")]
    assert len(manifests) == 1 and len(json.load(open(f"{tmp_out}/{manifests[0]}"))) == len(files(tmp_out)) == 4


def test_files_without_a_manifest_entry_are_not_read(spark, tmp_out):
    R.write_rasters(raster(spark, 100, 10), tmp_out, ["v"], None, 10)
    np.save(f"{tmp_out}/late_r0_c0.npy", np.ones((3, 3)))  # as a lost task would leave
    assert R.read_rasters(spark, tmp_out, ["v"]).count() == 100


def test_empty_folders_and_writes(spark, tmp_out):
    os.makedirs(tmp_out + "/none")
    assert R.read_rasters(spark, tmp_out + "/none", ["v"]).count() == 0
    R.write_rasters(raster(spark, 0), tmp_out + "/new", ["v"], None, 10)
    assert R.read_rasters(spark, tmp_out + "/new", ["v"]).count() == 0
    assert [f for f in os.listdir(tmp_out + "/new") if f.startswith("_manifest-")]


def test_bands_are_aligned_in_tasks_of_few_pixels(spark, tmp_out, monkeypatch):
    from emberspark.sources import bands as B
    paths, scans, read = {}, [], R.read_rasters
    for label, value in (("B04", 1.0), ("B08", 3.0)):
        paths[label] = f"{tmp_out}/{label}"
        os.makedirs(paths[label])
        np.save(f"{paths[label]}/a_r0_c0.npy", np.full((1600, 1600), value))  # 20 MB
        np.save(f"{paths[label]}/b_r0_c0.npy", np.full((3, 5), value))
    monkeypatch.setattr(R, "read_rasters", lambda *a, **k: scans.append(read(*a, **k)) or scans[-1])
    wide = B.load_band_files(spark, paths, ("tile", "px_row", "px_col"), "raster")
    assert [s.rdd.getNumPartitions() >= 3 for s in scans] == [True, True]
    got = wide.where("tile = 'b' OR px_row = 1599 AND px_col >= 1590").collect()
    assert len(got) == 25 and {(r.b04, r.b08) for r in got} == {(1.0, 3.0)}
