"""End-to-end compositions of the operators (what a user calls).

Each returns lazy DataFrames; nothing is collected. Actions happen only in
the sinks the caller chooses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import geo as G
from ..functions.scores import score_label
from ..operators import indices as I
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import scoring as SCO
from ..operators import stats as ST


def bands_to_indices(bands: DataFrame, only: list[str] | None = None) -> DataFrame:
    """E-03: ingest rule + every index whose bands exist."""
    return I.add_all_indices(Q.ingest_bands(bands), only)


def indices_to_risk(indexed: DataFrame, weights=None) -> DataFrame:
    """E-02: calibrated score and class over the present indices."""
    return SCO.add_class(SCO.add_calibrated_score(indexed, weights))


def scene_record(scored: DataFrame, bbox=S.STUDY_AREA) -> DataFrame:
    """E-08 record for a scored pixel set: means, label of the mean score,
    % high-risk over all pixels, the study-area box and its rough area."""
    x0, y0, x1, y1 = bbox
    agg = scored.agg(
        F.avg("risk_score").alias("m"), F.avg("ndvi").alias("ndvi_m"), F.avg("ndmi").alias("ndmi_m"),
        F.avg("nbr").alias("nbr_m"),
        F.count_if(F.col("risk_category") >= 4).alias("hi"),
        F.count_if(F.col("risk_category") > 0).alias("valid"),
        F.count(F.lit(1)).alias("n"))
    return agg.select(
        ST.r6("m").alias("mean_risk_score"), score_label("m").alias("risk_category"),
        ST.r6("ndvi_m").alias("ndvi_mean"), ST.r6("ndmi_m").alias("ndmi_mean"), ST.r6("nbr_m").alias("nbr_mean"),
        ST.r6(F.col("hi") / F.col("n") * F.lit(100.0)).alias("high_risk_percentage"),
        F.col("n").alias("total_pixels"), F.col("valid").alias("valid_pixels"),
        G.degree_box_hectares(F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)).alias("area_hectares"))


@dataclass
class Assessment:
    """E-01 outputs, all lazy."""
    scored: DataFrame
    area_statistics: DataFrame
    summary: DataFrame
    record: DataFrame


def full_assessment(bands: DataFrame, weights=None, cloud_mask: bool = True,
                    pixel_area_m2: float = S.PIXEL_AREA_M2, bbox=S.STUDY_AREA) -> Assessment:
    """E-01: bands -> (mask) -> indices -> calibrated score -> class -> reports."""
    px = Q.ingest_bands(bands)
    if cloud_mask:
        px = Q.apply_cloud_mask(px)
    scored = indices_to_risk(I.add_all_indices(px), weights)
    return Assessment(
        scored=scored,
        area_statistics=ST.area_statistics(scored, pixel_area_m2=pixel_area_m2),
        summary=ST.run_summary(scored),
        record=scene_record(scored, bbox),
    )


def quick_assessment(indexed: DataFrame) -> DataFrame:
    """E-04: simple model on NDVI (and NDMI when present) -> classes."""
    return SCO.add_class(SCO.add_simple_score(indexed))


def large_raster(bands: DataFrame) -> DataFrame:
    """E-05: fast indices + fast score; chunking is only a write clustering."""
    return SCO.add_fast_score(I.add_fast_indices(Q.ingest_bands(bands)))


def tile_batch(bands: DataFrame, tile: str = "tile_id", per_batch: int = S.TILES_PER_BATCH):
    """E-06: per-tile mean (calibrated), batch ids, and per-batch/overall reports."""
    scored = SCO.add_calibrated_score(I.add_all_indices(Q.ingest_bands(bands)))
    means = ST.tile_means(scored, tile)
    batches = R.batch_assignment(means.select(tile), tile, per_batch)
    per_batch_report = ST.batch_report(means.join(batches, tile), by=["batch_id"])
    return means, batches, per_batch_report, ST.batch_report(means)


def date_series(bands: DataFrame, bbox=None, date: str = "scene_date"):
    """E-07: optional study-area filter (when pixels carry lon/lat), fast
    score, per-date statistics and the struct-of-arrays export."""
    px = Q.ingest_bands(bands)
    if bbox is not None and not {"lon", "lat"} <= set(px.columns):
        raise ValueError("a study area needs pixels with lon and lat")
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        px = px.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
    series = ST.time_series(SCO.add_fast_score(I.add_fast_indices(px)), date)
    return series, ST.series_arrays(series, date)


def quick_ndvi(red: DataFrame, nir: DataFrame, keys=("px_row", "px_col"),
               red_col: str = "b04", nir_col: str = "b08") -> DataFrame:
    """P-05: NDVI straight from two single-band sources, aligned by pixel key
    (J-05: an equi-join on the key; a key present in only one band gives a
    NULL band and so a NULL index, never a silently shifted pixel)."""
    keys = list(keys)
    r = red.select(*keys, F.col(red_col).alias("b04"))
    n = nir.select(*keys, F.col(nir_col).alias("b08"))
    return I.add_ndvi(r.join(n, keys, "full_outer"))


def map_feed(scored: DataFrame, height, width, bounds=S.STUDY_AREA, vmin: float = 0.0, vmax: float = 100.0):
    """E-09: everything a map layer needs, as DataFrames: class RGBA and score
    palette per pixel, sampled high-risk markers with popups, legend rows."""
    from ..functions import colour as C
    from ..schema import category_dim
    rgba = C.category_rgba("risk_category")
    bucket = C.palette_bucket("risk_score", vmin, vmax)
    ramp = C.ramp_rgb(bucket)
    layers = scored.select(
        "px_row", "px_col", "risk_category",
        *[v.alias("class_" + k) for k, v in rgba.items()],
        bucket.alias("score_bucket"), *[v.alias("score_" + k) for k, v in ramp.items()],
        F.when(bucket.isNull(), F.lit(0)).otherwise(F.lit(255)).alias("score_a"))
    markers = R.high_risk_markers(scored, height, width, bounds, popup=True)
    legend = category_dim(scored.sparkSession)
    return {"layers": layers, "markers": markers, "legend": legend}


def assessment_record(scored: DataFrame, bbox=S.STUDY_AREA, assessment_date=None,
                      processing_ts=None, by: list[str] | None = None, metadata: dict | None = None) -> DataFrame:
    """E-08: one ``risk_assessments`` row per group of scored pixels (the
    whole set when ``by`` is empty): NaN-free means, the label of the mean
    score (``Unknown`` when every pixel is no data), the study-area polygon,
    its rough area, metadata JSON and timestamps. ``assessment_date`` /
    ``processing_ts`` default to today / now; pass columns or literals for
    reproducible re-runs. The id is a hash of (date, polygon, group).
    """
    from ..sources.sinks import assessment_ids, metadata_json
    by = list(by or [])
    x0, y0, x1, y1 = bbox
    date = F.current_date() if assessment_date is None else F.lit(assessment_date).cast("date")
    ts = F.current_timestamp() if processing_ts is None else F.lit(processing_ts).cast("timestamp")
    agg = scored.groupBy(*by).agg(
        F.avg("risk_score").alias("risk_score"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("ndvi", "ndmi", "nbr") if c in scored.columns])
    for c in ("ndvi", "ndmi", "nbr"):
        if f"{c}_mean" not in agg.columns:
            agg = agg.withColumn(f"{c}_mean", F.lit(None).cast("double"))
    box = {k: F.lit(float(v)) for k, v in zip(("xmin", "ymin", "xmax", "ymax"), bbox)}
    rec = agg.select(
        *by, date.alias("assessment_date"),
        G.box_wkt(*box.values()).alias("geom_wkt"),
        *[v.alias(k) for k, v in box.items()],
        G.box_ring(*box.values()).alias("ring"),
        "risk_score", score_label("risk_score").alias("risk_category"),
        "ndvi_mean", "ndmi_mean", "nbr_mean",
        G.degree_box_hectares(*box.values()).alias("area_hectares"),
        metadata_json(ts, metadata).alias("metadata"),
        ts.alias("created_at"), ts.alias("updated_at"))
    return rec.withColumn("id", assessment_ids(["assessment_date", "geom_wkt", *by]))


def save_assessment(scored: DataFrame, table_path: str, bbox=S.STUDY_AREA, run_key: str | None = None, **kw):
    """E-08 end to end: record -> constraint check -> append valid rows.
    Returns (ids written, quarantined rows) as DataFrames."""
    from ..sources.sinks import append_assessments
    rec = assessment_record(scored, bbox, **kw)
    rec = rec.drop("id")  # ids from the whole record, see append_assessments
    valid, bad = Q.split_valid(rec)
    empty = valid.where(F.col("risk_score").isNull())  # every pixel masked: nothing was assessed
    bad = bad.unionByName(empty.withColumn("reason", F.lit("no valid pixel")), allowMissingColumns=True)
    return append_assessments(valid.where(F.col("risk_score").isNotNull()), table_path, run_key=run_key), bad
