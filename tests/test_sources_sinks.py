"""Readers and writers: array files, logs, band layouts, synthetic scene, sinks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver_tables import SF_SMALL
from emberspark.plans import catalogue as CAT
from emberspark.sources import arrays as A
from emberspark.sources import bands as B
from emberspark.sources import sinks as K


def test_npy_cube_scan(spark, tmp_out):
    cube = np.arange(3 * 4 * 4, dtype=np.float32).reshape(3, 4, 4)
    cube[1, 2, 0] = np.nan
    np.save(os.path.join(tmp_out, "scene.npy"), cube)
    df = A.read_npy(spark, tmp_out)
    rows = {(r.px_row, r.px_col): r for r in df.collect()}
    assert len(rows) == 12
    assert rows[(2, 3)].b12 == float(cube[2, 3, 3])
    assert rows[(1, 2)].b04 is None


def test_npy_chunk_roundtrip(spark, tmp_out):
    g = CAT.grid_fast(spark, SF_SMALL)
    written = A.write_npy_chunks(g, tmp_out + "/chunks", 16, ["risk_score"]).collect()
    assert all(w.height <= 16 and w.width <= 16 for w in written)
    back = A.read_npy(spark, tmp_out + "/chunks", bands=("risk_score",))
    a = {(r.px_row, r.px_col, r.risk_score) for r in g.select("px_row", "px_col", "risk_score").collect()}
    b = {(r.px_row, r.px_col, r.risk_score) for r in back.select("px_row", "px_col", "risk_score").collect()}
    assert a == b
    cat = A.tile_catalogue(spark, tmp_out + "/chunks", "*.npy").collect()
    assert len(cat) == len(written) and all(c.bytes > 0 for c in cat)


def test_log_scan_reads_published_format(spark, tmp_out):
    os.makedirs(tmp_out + "/logs")
    with open(tmp_out + "/logs/batch_001.log", "w") as fh:
        fh.write("Processing tile: tile_001\nTile tile_001 processed: mean risk = 12.34\n"
                 "Processing tile: tile_002\nTile tile_002 processed: mean risk = 56.00\n")
    with open(tmp_out + "/logs/batch_002.log", "w") as fh:
        fh.write("Processing tile: tile_003\nsomething else\n")
    r = A.read_tile_logs(spark, tmp_out + "/logs").first()
    assert (r.tiles, r.scores, r.min_risk, r.max_risk) == (3, 2, 12.34, 56.0)
    assert abs(r.avg_risk - 34.17) < 1e-9


def test_long_wide_roundtrip_and_alignment(spark):
    g = CAT.grid(spark, SF_SMALL).drop("assessment_id")
    long = B.wide_to_long(g, ["px_row", "px_col"])
    assert long.count() == 4 * g.count()
    wide = B.long_to_wide(long, ["px_row", "px_col"])
    assert sorted(wide.collect()) == sorted(g.select("px_row", "px_col", "b04", "b08", "b11", "b12").collect())
    assert B.alignment_report(long, ["px_row", "px_col"]).count() == 0
    broken = long.where(~((F.col("px_row") == 0) & (F.col("px_col") == 0) & (F.col("band") == "B12")))
    assert B.alignment_report(broken, ["px_row", "px_col"]).count() == 1


def test_index_table_and_risk_map_sinks(spark, tmp_out):
    scored = CAT.masked_scored(spark, SF_SMALL)
    K.write_index_table(scored, tmp_out + "/idx", ["ndvi", "ndmi", "nbr"])
    back = spark.read.parquet(tmp_out + "/idx")
    assert back.count() == scored.count()
    assert "scene_date" in back.columns
    try:
        K.write_index_table(scored.drop("scene_date"), tmp_out + "/idx2", ["ndvi"])
        raise AssertionError("expected a missing-metadata error")
    except ValueError:
        pass
    K.write_risk_map(scored.select("tile_id", "px_row", "px_col", "risk_score"), tmp_out + "/map", num_files=3)
    assert spark.read.parquet(tmp_out + "/map").count() == scored.count()


def test_assessment_append_ids_are_idempotent(spark, tmp_out):
    from emberspark.sources import fixtures as FX
    a = FX.assessments(spark, SF_SMALL).drop("id").orderBy("assessment_date", "geom_wkt").limit(5)
    ids1 = sorted(r.id for r in K.append_assessments(a, tmp_out + "/ra").collect())
    assert len(ids1) == 5
    again = K.append_assessments(a, tmp_out + "/ra")          # a re-run writes nothing new
    assert again.count() == 0
    assert sorted(r.id for r in spark.read.parquet(tmp_out + "/ra").collect()) == ids1
    b = FX.assessments(spark, SF_SMALL).drop("id").orderBy("assessment_date", "geom_wkt").limit(8)
    new_ids = K.append_assessments(b, tmp_out + "/ra").collect()     # overlaps partly with a
    stored = {r.id for r in spark.read.parquet(tmp_out + "/ra").select("id").collect()}
    assert {r.id for r in new_ids}.isdisjoint(ids1) and {r.id for r in new_ids} <= stored
    assert len(stored) == len(set(ids1) | {r.id for r in new_ids})
    K.append_assessments(a, tmp_out + "/ra", skip_existing=False)
    assert spark.read.parquet(tmp_out + "/ra").count() == len(stored) + 5


def test_metadata_json_null_when_empty(spark):
    df = spark.range(1)
    ts = F.lit("2024-01-05 00:00:00").cast("timestamp")
    m = df.select(K.metadata_json(ts, {"scene": "a", "none": F.lit(None)}).alias("m"), K.metadata_json().alias("n"),
                  K.metadata_json(None, {"none": F.lit(None)}).alias("o")).first()
    assert m.m == '{"scene":"a","processing_date":"2024-01-05T00:00:00"}' and m.n is None and m.o is None


def test_append_by_run_and_duplicates_in_a_batch(spark, tmp_out):
    from emberspark.sources import fixtures as FX
    a = FX.assessments(spark, SF_SMALL).drop("id").orderBy("assessment_date", "geom_wkt").limit(3)
    path = tmp_out + "/runs"
    assert K.append_assessments(a.unionAll(a), path, run_key="one").count() == 3
    assert K.append_assessments(a, path, run_key="two").count() == 3     # same area and day, another run
    assert K.append_assessments(a, path, run_key="two").count() == 0
    assert spark.read.parquet(path).count() == 6
    with open(tmp_out + "/broken.parquet", "wb") as f:                   # a damaged table is not "no table"
        f.write(b"not parquet")
    with pytest.raises(Exception):
        K.append_assessments(a, tmp_out + "/broken.parquet")


def test_series_json_sink(spark, tmp_out):
    arr = CAT.q_series_arrays(spark, SF_SMALL)
    K.write_series_json(arr, tmp_out + "/series")
    back = spark.read.json(tmp_out + "/series").first()
    assert len(back.dates) == len(back.mean_risks) == len(back.high_risk_areas)
    assert list(back.dates) == sorted(back.dates)




def test_tables_and_pixel_results_sink(spark, tmp_out):
    K.create_tables(spark, tmp_out + "/warehouse")
    assert spark.table("risk_assessments").count() == 0
    assert "assessment_id" in spark.table("pixel_results").columns
    spark.sql("DROP TABLE risk_assessments")
    spark.sql("DROP TABLE pixel_results")
    pr = CAT.q_pixel_results(spark, SF_SMALL)
    K.write_pixel_results(pr, tmp_out + "/pr")
    assert spark.read.parquet(tmp_out + "/pr").count() == pr.count()


def test_map_feed(spark):
    from emberspark.plans.assessment import map_feed
    g = CAT.grid_scored(spark, SF_SMALL)
    h, w = CAT.grid_extent(g)
    feed = map_feed(g, h, w)
    assert feed["legend"].count() == 5
    assert feed["layers"].count() == g.count()
    m = feed["markers"].collect()
    assert m and all(" hazard, score " in r.popup for r in m)


def test_assessment_record_and_save(spark, tmp_out):
    from emberspark.plans.assessment import assessment_record, save_assessment
    scored = CAT.masked_scored(spark, SF_SMALL)
    rec = assessment_record(scored, assessment_date="2024-03-01", processing_ts="2024-03-01 10:00:00").first()
    full = CAT.q_full_assessment(spark, SF_SMALL).first()
    assert round(rec.risk_score, 6) == full.mean_risk_score and rec.risk_category == full.risk_category
    assert rec.geom_wkt.startswith("POLYGON((150.0 -34.0, 150.8 -34.0")
    assert '"processing_date":"2024-03-01T10:00:00"' in rec.metadata
    assert abs(rec.area_hectares - 492840.0) < 1e-6
    ids, bad = save_assessment(scored, tmp_out + "/ra", by=["tile_id"], assessment_date="2024-03-01")
    assert ids.count() == scored.select("tile_id").distinct().count() and bad.count() == 0
    back = spark.read.parquet(tmp_out + "/ra")
    assert back.where("risk_score < 0 or risk_score > 100").count() == 0


def test_load_band_files_pivots_once(spark, tmp_out):
    from emberspark.sources.bands import load_band_files
    g = CAT.grid(spark, SF_SMALL)
    paths = {}
    for label, col in (("B04", "b04"), ("B08", "b08")):
        paths[label] = f"{tmp_out}/{label}"
        A.write_npy_chunks(g, paths[label], 32, [col]).count()
    wide = load_band_files(spark, paths)
    got = {(r.px_row, r.px_col): (r.b04, r.b08) for r in wide.collect()}
    exp = {(r.px_row, r.px_col): (r.b04, r.b08) for r in g.collect()}
    assert got == exp
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_cli_assess(tmp_out):
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from emberspark.session import build_session\n"
            "from emberspark.plans.catalogue import pixels\n"
            "s = build_session('local[2]'); pixels(s, %r).write.parquet(%r); s.stop()\n") % (root, SF_SMALL, tmp_out + "/px")
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    subprocess.run([sys.executable, "-m", "emberspark", "assess", "--pixels", tmp_out + "/px", "--out", tmp_out + "/o",
                    "--master", "local[2]"], check=True, capture_output=True, timeout=300, cwd=root)
    assert os.path.isdir(tmp_out + "/o/area_statistics") and os.path.isdir(tmp_out + "/o/scored")


def test_pluggable_decoder(spark, tmp_out):
    # a trivial raw format: 8-byte header (h, w as int32) + float64 plane
    import struct
    arr = np.arange(6, dtype=np.float64).reshape(2, 3)
    with open(os.path.join(tmp_out, "plane.raw"), "wb") as fh:
        fh.write(struct.pack("<ii", 2, 3) + arr.tobytes())

    def decode(content):
        h, w = struct.unpack("<ii", content[:8])
        return np.frombuffer(content[8:], dtype=np.float64).reshape(h, w)

    df = A.read_npy(spark, tmp_out, bands=("value",), glob="*.raw", decoder=decode)
    assert sorted((r.px_row, r.px_col, r.value) for r in df.collect()) == [
        (r, c, float(arr[r, c])) for r in range(2) for c in range(3)]


def test_index_table_has_descriptions(spark, tmp_out):
    scored = CAT.masked_scored(spark, SF_SMALL)
    K.write_index_table(scored, tmp_out + "/idx", ["ndvi", "risk_score"])
    meta = {f.name: f.metadata for f in spark.read.parquet(tmp_out + "/idx").schema.fields}
    assert meta["ndvi"]["comment"].startswith("NDVI")


def test_palette_as_data_equals_rule(spark):
    from emberspark import schema as S
    from emberspark.functions import colour as C
    g = CAT.grid_scored(spark, SF_SMALL).withColumn("bucket", C.palette_bucket("risk_score", 0, 100))
    joined = C.apply_palette(g, "bucket", S.palette_dim(spark)).select("px_row", "px_col", "r", "g", "b", "a")
    rule = C.ramp_rgb("bucket")
    direct = g.select("px_row", "px_col", rule["r"].alias("r"), rule["g"].alias("g"), rule["b"].alias("b"),
                      F.when(F.col("bucket").isNull(), 0).otherwise(255).alias("a"))
    assert sorted(joined.collect()) == sorted(direct.collect())


def test_several_values_of_a_band_raise(spark):
    long = spark.createDataFrame([(0, 0, "B04", 1.0), (0, 0, "B04", 2.0), (0, 1, "B04", 1.0)],
                                 "px_row int, px_col int, band string, value double")
    with pytest.raises(Exception, match="several values"):
        B.long_to_wide(long, ["px_row", "px_col"]).collect()
