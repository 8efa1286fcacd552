"""Registered queries: one Spark builder per operator, each with its SQL twin.

Every builder takes ``(spark, sf_dir)``, reads the driver tables through the
fixture shapes and returns a lazy DataFrame over the *whole* input. Columns
are aliased to the same names as in the SQL twin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import colour as C
from ..functions import geo as G
from ..functions import scores as SC
from ..operators import area as AR
from ..operators import indices as I
from ..operators import polygons as PG
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import scoring as SCO
from ..operators import spatial as SP
from ..operators import stats as ST
from ..operators import tiling as TL
from ..sources import fixtures as FX
from ..sources.tables import stored
from . import oracle as O

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- shared inputs

KEYS = ["tile_id", "px_row", "px_col", "scene_date"]
GRID_KEYS = ["px_row", "px_col"]


def pixels(spark, d) -> DataFrame:
    return Q.ingest_bands(FX.pixels(spark, d))


def masked(spark, d) -> DataFrame:
    return Q.apply_cloud_mask(pixels(spark, d))


def masked_scored(spark, d) -> DataFrame:
    return SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(masked(spark, d))), name=None)


def pixel_scored(spark, d) -> DataFrame:
    return SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(pixels(spark, d))), name=None)


def grid(spark, d) -> DataFrame:
    return Q.ingest_bands(FX.grid(spark, d))


def grid_scored(spark, d) -> DataFrame:
    return SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(grid(spark, d))), name=None)


def grid_fast(spark, d) -> DataFrame:
    return SCO.add_fast_score(I.add_fast_indices(grid(spark, d)))


def grid_extent(g: DataFrame):
    """Raster height and width from one scalar subquery (one small aggregate
    job, its single row inlined into the plan)."""
    ext = g.select(F.struct((F.max("px_row") + 1).alias("h"), (F.max("px_col") + 1).alias("w"))).scalar()
    return ext["h"], ext["w"]


W, Sth, E, N = S.STUDY_AREA
W_O = O.with_

# --------------------------------------------------------------------------- P-01..P-06 indices


@register("ndvi", W_O(O.PIXELS) + f"SELECT tile_id, px_row, px_col, scene_date, {O.cindex('b08', 'b04')} AS ndvi FROM pixels")
def q_ndvi(spark, d):
    return I.add_ndvi(pixels(spark, d)).select(*KEYS, "ndvi")


@register("ndmi", W_O(O.PIXELS) + f"SELECT tile_id, px_row, px_col, scene_date, {O.cindex('b08', 'b11')} AS ndmi FROM pixels")
def q_ndmi(spark, d):
    return I.add_ndmi(pixels(spark, d)).select(*KEYS, "ndmi")


@register("nbr", W_O(O.PIXELS) + f"SELECT tile_id, px_row, px_col, scene_date, {O.cindex('b08', 'b12')} AS nbr FROM pixels")
def q_nbr(spark, d):
    return I.add_nbr(pixels(spark, d)).select(*KEYS, "nbr")


@register("indices_all", W_O(O.PIXELS, O.idx("pixels", "pi"))
          + "SELECT tile_id, px_row, px_col, scene_date, ndvi, ndmi, nbr FROM pi")
def q_indices_all(spark, d):
    return I.add_all_indices(pixels(spark, d)).select(*KEYS, "ndvi", "ndmi", "nbr")


@register("indices_partial_bands", W_O(O.PIXELS)
          + f"SELECT tile_id, px_row, px_col, scene_date, ndvi, risk_score, {O.classify('risk_score')} AS risk_category "
            f"FROM (SELECT *, {O.calibrated(present=('NDVI',))} AS risk_score FROM "
            f"(SELECT *, {O.cindex('b08', 'b04')} AS ndvi FROM pixels) a) b")
def q_indices_partial_bands(spark, d):
    """Only red and NIR loaded: NDVI alone, score renormalised to its weight."""
    two_bands = pixels(spark, d).select(*KEYS, "b04", "b08")
    df = SCO.add_class(SCO.add_calibrated_score(I.add_all_indices(two_bands)), name=None)
    return df.select(*KEYS, "ndvi", "risk_score", "risk_category")


@register("indices_fast", W_O(O.PIXELS, O.fidx("pixels", "pf"))
          + "SELECT tile_id, px_row, px_col, scene_date, ndvi_fast, ndmi_fast, nbr_fast FROM pf")
def q_indices_fast(spark, d):
    return I.add_fast_indices(pixels(spark, d)).select(*KEYS, "ndvi_fast", "ndmi_fast", "nbr_fast")


# --------------------------------------------------------------------------- F-01, A-06 cloud mask


@register("cloud_mask", W_O(O.PIXELS, O.MASKED)
          + f"SELECT tile_id, px_row, px_col, scene_date, scl, coalesce(scl, -1) IN ({O.MASK_CODES}) AS masked, "
            f"b04, b08, b11, b12, {O.cindex('b08', 'b04')} AS ndvi FROM masked")
def q_cloud_mask(spark, d):
    df = Q.apply_cloud_mask(pixels(spark, d).withColumn("masked", Q.cloud_flag()))
    return I.add_ndvi(df).select(*KEYS, "scl", "masked", "b04", "b08", "b11", "b12", "ndvi")


@register("mask_count", W_O(O.PIXELS)
          + f"SELECT tile_id, count(CASE WHEN coalesce(scl, -1) IN ({O.MASK_CODES}) THEN 1 END) AS masked_pixels, "
            "count(*) AS total_pixels FROM pixels GROUP BY tile_id")
def q_mask_count(spark, d):
    return ST.mask_count(pixels(spark, d), Q.cloud_flag(), by=["tile_id"])


# --------------------------------------------------------------------------- P-08..P-13b, P-17/18 scores


@register("component_scores", W_O(O.PIXELS, O.idx("pixels", "pi"))
          + f"SELECT tile_id, px_row, px_col, scene_date, {O.health('NDVI', 'ndvi')} AS vegetation_health, "
            f"{O.health('NDMI', 'ndmi')} AS moisture_score, {O.health('NBR', 'nbr')} AS burn_resistance FROM pi")
def q_component_scores(spark, d):
    df = SCO.add_components(I.add_all_indices(pixels(spark, d)))
    return df.select(*KEYS, "vegetation_health", "moisture_score", "burn_resistance")


@register("risk_calibrated", W_O(*O.PIXEL_SCORED)
          + "SELECT tile_id, px_row, px_col, scene_date, risk_score, risk_category FROM pc")
def q_risk_calibrated(spark, d):
    return pixel_scored(spark, d).select(*KEYS, "risk_score", "risk_category")


CUSTOM_WEIGHTS = {"NDVI": 2.0, "NDMI": 1.0, "NBR": 1.0}


@register("risk_custom_weights", W_O(O.PIXELS, O.idx("pixels", "pi"),
                                     O.scored("pi", "ps", O.calibrated(weights=CUSTOM_WEIGHTS)),
                                     O.classed("ps", "pc"))
          + "SELECT tile_id, px_row, px_col, scene_date, risk_score, risk_category FROM pc")
def q_risk_custom_weights(spark, d):
    df = SCO.add_calibrated_score(I.add_all_indices(pixels(spark, d)), weights=CUSTOM_WEIGHTS)
    return SCO.add_class(df, name=None).select(*KEYS, "risk_score", "risk_category")


@register("risk_fast", W_O(O.PIXELS, O.fidx("pixels", "pf"), O.scored("pf", "ps", O.fast()), O.classed("ps", "pc"))
          + "SELECT tile_id, px_row, px_col, scene_date, risk_score, risk_category FROM pc")
def q_risk_fast(spark, d):
    df = SCO.add_fast_score(I.add_fast_indices(pixels(spark, d)))
    return SCO.add_class(df, name=None).select(*KEYS, "risk_score", "risk_category")


@register("risk_simple", W_O(O.PIXELS, O.idx("pixels", "pi"), O.scored("pi", "ps", O.simple()), O.classed("ps", "pc"))
          + "SELECT tile_id, px_row, px_col, scene_date, risk_score, risk_category FROM pc")
def q_risk_simple(spark, d):
    df = SCO.add_simple_score(I.add_all_indices(pixels(spark, d), only=["NDVI", "NDMI"]))
    return SCO.add_class(df, name=None).select(*KEYS, "risk_score", "risk_category")


@register("risk_classes", W_O(*O.MASKED_SCORED)
          + f"SELECT tile_id, px_row, px_col, scene_date, risk_score, risk_category, "
            f"{O.cname('risk_category')} AS category_name FROM mc")
def q_risk_classes(spark, d):
    df = masked_scored(spark, d).withColumn("category_name", SC.category_name("risk_category"))
    return df.select(*KEYS, "risk_score", "risk_category", "category_name")


# --------------------------------------------------------------------------- A-01..A-08 aggregates


@register("class_distribution", W_O(*O.MASKED_SCORED)
          + f"SELECT risk_category, pixels, {O.r6('pixels / sum(pixels) OVER () * 100e0')} AS pct_all, "
            f"{O.cname('risk_category')} AS category_name "
            "FROM (SELECT risk_category, count(*) AS pixels FROM mc GROUP BY risk_category) g ORDER BY risk_category")
def q_class_distribution(spark, d):
    return ST.class_distribution(masked_scored(spark, d)).orderBy("risk_category")


AREA_SQL = (f"SELECT {{by}}risk_category, {O.cname('risk_category')} AS category_name, pixels, "
            "pixels * 100e0 AS area_m2, pixels * 100e0 / 10000e0 AS area_hectares, "
            f"{O.r6('pixels / sum(pixels) OVER ({part}) * 100e0')} AS pct_valid "
            "FROM (SELECT {by}risk_category, count(*) AS pixels FROM mc WHERE risk_category > 0 "
            "GROUP BY {by}risk_category) g")


@register("area_statistics", W_O(*O.MASKED_SCORED) + AREA_SQL.format(by="", part="") + " ORDER BY risk_category")
def q_area_statistics(spark, d):
    return ST.area_statistics(masked_scored(spark, d)).orderBy("risk_category")


@register("area_by_tile", W_O(*O.MASKED_SCORED) + AREA_SQL.format(by="tile_id, ", part="PARTITION BY tile_id") + " ORDER BY tile_id, risk_category")
def q_area_by_tile(spark, d):
    return ST.area_statistics(masked_scored(spark, d), by=["tile_id"]).orderBy("tile_id", "risk_category")


def _mmm_sql(cols):
    return ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, {O.r6(f'avg({c})')} AS {c}_mean" for c in cols)


@register("index_summary", W_O(O.PIXELS, O.MASKED, O.idx("masked", "mi"))
          + f"SELECT {_mmm_sql(['ndvi', 'ndmi', 'nbr'])} FROM mi")
def q_index_summary(spark, d):
    return ST.min_max_mean(I.add_all_indices(masked(spark, d)), ["ndvi", "ndmi", "nbr"])


@register("band_summary", W_O(O.PIXELS) + f"SELECT {_mmm_sql(['b04', 'b08', 'b11', 'b12'])} FROM pixels")
def q_band_summary(spark, d):
    return ST.min_max_mean(pixels(spark, d), ["b04", "b08", "b11", "b12"])


@register("risk_summary", W_O(*O.MASKED_SCORED)
          + "SELECT " + _mmm_sql(["vegetation_health", "moisture_score", "burn_resistance", "risk_score"])
          + f" FROM (SELECT *, {O.health('NDVI', 'ndvi')} AS vegetation_health, {O.health('NDMI', 'ndmi')} AS moisture_score, "
            f"{O.health('NBR', 'nbr')} AS burn_resistance FROM mc) x")
def q_risk_summary(spark, d):
    df = SCO.add_components(masked_scored(spark, d))
    return ST.min_max_mean(df, ["vegetation_health", "moisture_score", "burn_resistance", "risk_score"])


@register("run_summary", W_O(*O.MASKED_SCORED)
          + f"SELECT {O.r6('avg(risk_score)')} AS mean_risk_score, "
            f"{O.r6('count(CASE WHEN risk_category >= 4 THEN 1 END) / count(*) * 100e0')} AS high_risk_percentage, "
            "count(*) AS total_pixels FROM mc")
def q_run_summary(spark, d):
    return ST.run_summary(masked_scored(spark, d))


@register("scene_means", W_O(*O.MASKED_SCORED)
          + f"SELECT tile_id, scene_date, {O.r6('ndvi_mean')} AS ndvi_mean, {O.r6('ndmi_mean')} AS ndmi_mean, "
            f"{O.r6('nbr_mean')} AS nbr_mean, {O.r6('mean_risk_score')} AS mean_risk_score, "
            f"{O.cname(O.classify('mean_risk_score'))} AS risk_category, pixels FROM ("
            "SELECT tile_id, scene_date, avg(ndvi) AS ndvi_mean, avg(ndmi) AS ndmi_mean, avg(nbr) AS nbr_mean, "
            "avg(risk_score) AS mean_risk_score, count(*) AS pixels FROM mc GROUP BY tile_id, scene_date) g ORDER BY tile_id, scene_date")
def q_scene_means(spark, d):
    return ST.scene_means(masked_scored(spark, d), by=["tile_id", "scene_date"]).orderBy("tile_id", "scene_date")


# --------------------------------------------------------------------------- A-10, A-13, P-27 series


SERIES_SQL = (W_O(O.PIXELS, O.fidx("pixels", "pf"), O.scored("pf", "ps", O.fast()))
              + f"SELECT scene_date, {O.r6('avg(risk_score)')} AS mean_risk, max(risk_score) AS max_risk, "
                f"{O.r6(f'count(CASE WHEN risk_score > {O.d(O.SERIES)} THEN 1 END) / count(*) * 100e0')} "
                "AS high_risk_area FROM ps GROUP BY scene_date")


def series(spark, d) -> DataFrame:
    return ST.time_series(SCO.add_fast_score(I.add_fast_indices(pixels(spark, d))))


@register("time_series", SERIES_SQL + " ORDER BY scene_date")
def q_time_series(spark, d):
    return series(spark, d).orderBy("scene_date")


@register("series_arrays", "WITH s AS (" + SERIES_SQL + ")\n"
          "SELECT list(scene_date ORDER BY scene_date) AS dates, list(mean_risk ORDER BY scene_date) AS mean_risks, "
          "list(max_risk ORDER BY scene_date) AS max_risks, "
          "list(high_risk_area ORDER BY scene_date) AS high_risk_areas FROM s")
def q_series_arrays(spark, d):
    return ST.series_arrays(series(spark, d))


@register("date_sequence", W_O(O.PIXELS)
          + "SELECT s.scene_date, coalesce(c.pixels, 0) AS pixels FROM ("
            "SELECT CAST(unnest(generate_series(min(scene_date), max(scene_date), INTERVAL 1 MONTH)) AS DATE) "
            "AS scene_date FROM pixels) s LEFT JOIN (SELECT scene_date, count(*) AS pixels FROM pixels "
            "GROUP BY scene_date) c ON s.scene_date = c.scene_date")
def q_date_sequence(spark, d):
    """Every month between the first and last scene date, with pixel counts
    (0 for months without a scene)."""
    px = pixels(spark, d)
    months = px.agg(F.explode(F.sequence(F.min("scene_date"), F.max("scene_date"),
                                         F.expr("INTERVAL 1 MONTH"))).alias("scene_date"))
    counts = px.groupBy("scene_date").agg(F.count(F.lit(1)).alias("pixels"))
    return (months.join(counts, "scene_date", "left")
                  .select("scene_date", F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels")))


# --------------------------------------------------------------------------- P-15, P-16 chunks and strips

CHUNK = 32
STRIPS = 7


@register("chunk_grid", W_O(*O.GRID_FAST)
          + f"SELECT chunk_y, chunk_x, count(*) AS pixels, {O.r6('avg(risk_score)')} AS mean_risk, "
            f"chunk_y * {CHUNK} AS y_start, least((chunk_y + 1) * {CHUNK}, (SELECT max(px_row) + 1 FROM grid)) AS y_end, "
            f"chunk_x * {CHUNK} AS x_start, least((chunk_x + 1) * {CHUNK}, (SELECT max(px_col) + 1 FROM grid)) AS x_end "
            f"FROM (SELECT *, CAST(floor(px_row / {CHUNK}) AS INTEGER) AS chunk_y, "
            f"CAST(floor(px_col / {CHUNK}) AS INTEGER) AS chunk_x FROM gfs) c GROUP BY chunk_y, chunk_x")
def q_chunk_grid(spark, d):
    g = grid_fast(spark, d)
    height, width = grid_extent(g)
    chunks = g.withColumns(TL.chunk_keys(size=CHUNK))
    agg = chunks.groupBy("chunk_y", "chunk_x").agg(
        F.count(F.lit(1)).alias("pixels"), ST.r6(F.avg("risk_score")).alias("mean_risk"))
    return agg.withColumns(TL.chunk_bounds(height, width, CHUNK))


@register("row_strips", W_O(*O.GRID_FAST)
          + f"SELECT strip, min(px_row) AS first_row, max(px_row) AS last_row, count(*) AS pixels, "
            f"{O.r6('avg(risk_score)')} AS mean_risk FROM (SELECT *, CAST(CASE WHEN "
            f"floor((SELECT max(px_row) + 1 FROM grid) / {STRIPS}) > 0 THEN "
            f"least(floor(px_row / floor((SELECT max(px_row) + 1 FROM grid) / {STRIPS})), {STRIPS - 1}) "
            f"ELSE {STRIPS - 1} END AS INTEGER) AS strip FROM gfs) s GROUP BY strip")
def q_row_strips(spark, d):
    g = grid_fast(spark, d)
    height, _ = grid_extent(g)
    s = g.withColumn("strip", TL.strip_key("px_row", height, STRIPS))
    return s.groupBy("strip").agg(
        F.min("px_row").alias("first_row"), F.max("px_row").alias("last_row"),
        F.count(F.lit(1)).alias("pixels"), ST.r6(F.avg("risk_score")).alias("mean_risk"))


# --------------------------------------------------------------------------- P-14, A-11 tiles and batches


@register("batch_assignment", W_O(O.PIXELS)
          + f"SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS tile_ordinal, "
            f"CAST(floor((row_number() OVER (ORDER BY tile_id) - 1) / {O.BATCH}) AS BIGINT) AS batch_id "
            "FROM (SELECT DISTINCT tile_id FROM pixels) t")
def q_batch_assignment(spark, d):
    return R.batch_assignment(pixels(spark, d).select("tile_id"))


@register("tile_batch_report", W_O(*O.PIXEL_SCORED)
          + f"SELECT count(*) AS tiles, {O.r6('avg(tile_mean_risk)')} AS avg_risk, min(tile_mean_risk) AS min_risk, "
            "max(tile_mean_risk) AS max_risk FROM (SELECT tile_id, round(avg(risk_score), 2) AS tile_mean_risk "
            "FROM pc GROUP BY tile_id) t")
def q_tile_batch_report(spark, d):
    return ST.batch_report(ST.tile_means(pixel_scored(spark, d)))


# --------------------------------------------------------------------------- P-22, P-23, S-12 coordinates

H_SQL = "(SELECT max(px_row) + 1 FROM grid)"
W_SQL = "(SELECT max(px_col) + 1 FROM grid)"
LAT_SQL = f"{O.d(O.STUDY["S"])} + {O.d(O.STUDY["N"] - O.STUDY["S"])} * (1e0 - px_row / {H_SQL})"
LON_SQL = f"{O.d(O.STUDY["W"])} + {O.d(O.STUDY["E"] - O.STUDY["W"])} * (px_col / {W_SQL})"


def _lat_lon(g: DataFrame):
    height, width = grid_extent(g)
    return {"lat": G.pixel_lat("px_row", height, Sth, N), "lon": G.pixel_lon("px_col", width, W, E)}


@register("pixel_lonlat", W_O(O.GRID) + f"SELECT px_row, px_col, {LAT_SQL} AS lat, {LON_SQL} AS lon FROM grid")
def q_pixel_lonlat(spark, d):
    g = grid(spark, d)
    return g.withColumns(_lat_lon(g)).select(*GRID_KEYS, "lat", "lon")


TILE_W, TILE_H = 0.2, 0.125


def tile_scenes(px: DataFrame) -> DataFrame:
    """Scene metadata per tile (S-03): size from the data, transform by rule
    (a 4 x 4 tile layout over the study area, north-up)."""
    from ..sources.bands import scene_metadata
    t = F.col("tile_id")
    return scene_metadata(px).withColumns({
        "a": F.lit(TILE_W) / F.col("width"),
        "c": F.lit(W) + (t % 4) * F.lit(TILE_W),
        "e": F.lit(-TILE_H) / F.col("height"),
        "f": F.lit(N) - F.floor(t / F.lit(4)) * F.lit(TILE_H)})


@register("pixel_affine", W_O(O.PIXELS)
          + ", scenes AS (SELECT tile_id, max(px_col) + 1 AS width, max(px_row) + 1 AS height FROM pixels GROUP BY tile_id)"
            f", tr AS (SELECT tile_id, {O.d(TILE_W)} / width AS a, 0e0 AS b, {O.d(W)} + (tile_id % 4) * {O.d(TILE_W)} AS c, "
            f"0e0 AS d, {O.d(-TILE_H)} / height AS e, {O.d(N)} - floor(tile_id / 4) * {O.d(TILE_H)} AS f FROM scenes)\n"
            "SELECT p.tile_id, p.px_row, p.px_col, p.scene_date, a * px_col + b * px_row + c AS x, "
            "d * px_col + e * px_row + f AS y FROM pixels p JOIN tr ON p.tile_id = tr.tile_id")
def q_pixel_affine(spark, d):
    px = pixels(spark, d)
    # The scene catalogue is a stored table of one row a tile: its static size decides for a broadcast, no pixel is shuffled.
    j = px.join(stored(tile_scenes(px)), "tile_id")
    return j.select(*KEYS, G.affine_x("px_col", "px_row", "a", "b", "c").alias("x"),
                    G.affine_y("px_col", "px_row", "d", "e", "f").alias("y"))


@register("scene_metadata", W_O(O.PIXELS)
          + ", scenes AS (SELECT tile_id, max(px_col) + 1 AS width, max(px_row) + 1 AS height FROM pixels GROUP BY tile_id)\n"
            f"SELECT tile_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, {O.d(TILE_W)} / width AS a, 0e0 AS b, "
            f"{O.d(W)} + (tile_id % 4) * {O.d(TILE_W)} AS c, 0e0 AS d, {O.d(-TILE_H)} / height AS e, "
            f"{O.d(N)} - floor(tile_id / 4) * {O.d(TILE_H)} AS f, 'EPSG:4326' AS crs FROM scenes ORDER BY tile_id")
def q_scene_metadata(spark, d):
    """The stored scene catalogue: size, transform and reference system of every tile."""
    scenes = stored(tile_scenes(pixels(spark, d)))
    return scenes.withColumns({c: F.col(c).cast("long") for c in ("width", "height")}).orderBy("tile_id")


@register("pixel_results", W_O(*O.GRID_SCORED)
          + f"SELECT assessment_id, px_row, px_col, {LON_SQL} AS lon, {LAT_SQL} AS lat, risk_score, risk_category, "
            "ndvi, ndmi, nbr FROM gc")
def q_pixel_results(spark, d):
    g = grid_scored(spark, d)
    return g.withColumns(_lat_lon(g)).select(
        "assessment_id", *GRID_KEYS, "lon", "lat", "risk_score", "risk_category", "ndvi", "ndmi", "nbr")


@register("high_risk_pixels", W_O(*O.GRID_SCORED)
          + f"SELECT px_row, px_col, {LAT_SQL} AS lat, {LON_SQL} AS lon, risk_score, risk_category "
            "FROM gc WHERE risk_category >= 4")
def q_high_risk_pixels(spark, d):
    g = grid_scored(spark, d)
    return (SC.where_computed(g, SC.class_at_least("risk_score", 4)).withColumns(_lat_lon(g))
             .select(*GRID_KEYS, "lat", "lon", "risk_score", "risk_category"))


@register("risk_markers", W_O(*O.GRID_SCORED)
          + ", hr AS (SELECT *, row_number() OVER (ORDER BY px_row, px_col) - 1 AS idx, count(*) OVER () AS n "
            "FROM gc WHERE risk_category >= 4)\n"
            f"SELECT idx // greatest(1, n // {O.MARKERS}) AS sample_rank, px_row, px_col, {LAT_SQL} AS lat, "
            f"{LON_SQL} AS lon, risk_score, {O.cname('risk_category')} AS category_name FROM hr "
            f"WHERE idx % greatest(1, n // {O.MARKERS}) = 0")
def q_risk_markers(spark, d):
    g = grid_scored(spark, d)
    height, width = grid_extent(g)
    return R.high_risk_markers(g, height, width)


# --------------------------------------------------------------------------- P-28..P-30 colour feeds


def _hex_sql(h: str, i: int) -> str:
    return f"CAST(('0x' || substr({h}, {2 * i + 2}, 2)) AS INTEGER)"


@register("class_colours", W_O(*O.GRID_SCORED)
          + f"SELECT px_row, px_col, risk_category, coalesce({_hex_sql(O.ccolour('risk_category'), 0)}, 0) AS r, "
            f"coalesce({_hex_sql(O.ccolour('risk_category'), 1)}, 0) AS g, "
            f"coalesce({_hex_sql(O.ccolour('risk_category'), 2)}, 0) AS b, "
            f"CASE WHEN {O.ccolour('risk_category')} IS NULL THEN 0 ELSE 255 END AS a FROM gc")
def q_class_colours(spark, d):
    return grid_scored(spark, d).select(*GRID_KEYS, "risk_category", *[
        v.alias(k) for k, v in C.category_rgba("risk_category").items()])


PALETTE_STEPS = 256


@register("score_palette_bucket", W_O(*O.GRID_SCORED)
          + ", bk AS (SELECT px_row, px_col, CASE WHEN risk_score IS NOT NULL THEN CAST(least(floor("
            + O.clip("(risk_score - 0e0) / 100e0", 0.0, 1.0)
            + f" * {PALETTE_STEPS}e0), {PALETTE_STEPS - 1}) AS INTEGER) END AS bucket FROM gc)\n"
            f"SELECT px_row, px_col, bucket, CASE WHEN bucket IS NOT NULL THEN 255 END AS r, "
            f"230 - CAST(floor(210 * bucket / {PALETTE_STEPS - 1}) AS INTEGER) AS g, "
            f"CAST(floor(60 * ({PALETTE_STEPS - 1} - bucket) / {PALETTE_STEPS - 1}) AS INTEGER) AS b, "
            "CASE WHEN bucket IS NULL THEN 0 ELSE 255 END AS a FROM bk")
def q_score_palette_bucket(spark, d):
    g = grid_scored(spark, d).withColumn("bucket", C.palette_bucket("risk_score", 0.0, 100.0, PALETTE_STEPS))
    rgb = C.ramp_rgb("bucket", PALETTE_STEPS)
    return g.select(*GRID_KEYS, "bucket", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"),
                    F.when(F.col("bucket").isNull(), F.lit(0)).otherwise(F.lit(255)).alias("a"))


# --------------------------------------------------------------------------- S-01/J-05, U-01


@register("bands_long_to_wide", W_O(O.GRID)
          + f"SELECT px_row, px_col, b04, b08, b11, b12, {O.cindex('b08', 'b04')} AS ndvi FROM grid")
def q_bands_long_to_wide(spark, d):
    from ..sources.bands import long_to_wide, wide_to_long
    long = wide_to_long(grid(spark, d), GRID_KEYS)
    wide = long_to_wide(long, GRID_KEYS)
    return I.add_ndvi(wide).select(*GRID_KEYS, "b04", "b08", "b11", "b12", "ndvi")


@register("scene_union", W_O(O.PIXELS, O.GRID)
          + f"SELECT 'pixels' AS source, tile_id, px_row, px_col, scene_date, {O.cindex('b08', 'b04')} AS ndvi FROM pixels "
            f"UNION ALL SELECT 'grid' AS source, CAST(NULL AS BIGINT) AS tile_id, CAST(px_row AS BIGINT) AS px_row, "
            f"px_col, CAST(NULL AS DATE) AS scene_date, {O.cindex('b08', 'b04')} AS ndvi FROM grid")
def q_scene_union(spark, d):
    """Scenes with different column sets combined by name."""
    a = pixels(spark, d).withColumn("source", F.lit("pixels"))
    b = grid(spark, d).drop("assessment_id").withColumn("source", F.lit("grid"))
    u = a.unionByName(b, allowMissingColumns=True)
    return I.add_ndvi(u).select("source", "tile_id", "px_row", "px_col", "scene_date", "ndvi")


# --------------------------------------------------------------------------- F-02, F-03, A-09, A-12, F-06


ASSESS_COLS = ["id", "assessment_date", "geom_wkt", "risk_score", "risk_category", "area_hectares"]
ASSESS_SQL = ", ".join(ASSESS_COLS)
BBOX = (150.1, -33.9, 150.3, -33.8)


@register("assessments_in_bbox", W_O(O.ASSESSMENTS)
          + f"SELECT {ASSESS_SQL} FROM assessments WHERE xmin <= {O.d(BBOX[2])} AND xmax >= {O.d(BBOX[0])} "
            f"AND ymin <= {O.d(BBOX[3])} AND ymax >= {O.d(BBOX[1])} ORDER BY assessment_date DESC, id")
def q_assessments_in_bbox(spark, d):
    return SP.newest_first(SP.bbox_filter(FX.assessments(spark, d), BBOX)).select(*ASSESS_COLS)


@register("high_risk_assessments", W_O(O.ASSESSMENTS)
          + f"SELECT {ASSESS_SQL} FROM assessments WHERE risk_score >= 60e0 "
            "ORDER BY risk_score DESC, assessment_date DESC, id")
def q_high_risk_assessments(spark, d):
    return SP.score_at_least(FX.assessments(spark, d), 60.0).select(*ASSESS_COLS)


STATS_SQL = ("SELECT count(*) AS total_assessments, " + O.r6("avg(risk_score)") + " AS avg_risk_score, "
             "min(risk_score) AS min_risk_score, max(risk_score) AS max_risk_score, "
             + O.r6("sum(area_hectares)") + " AS total_area_hectares, "
             + ", ".join(f"count(CASE WHEN risk_category = '{name}' THEN 1 END) AS {name.lower().replace(' ', '_')}_count"
                         for name in ("Very High", "High", "Moderate", "Low", "Very Low"))
             + " FROM assessments")


@register("assessment_statistics", W_O(O.ASSESSMENTS) + STATS_SQL)
def q_assessment_statistics(spark, d):
    return ST.assessment_statistics(FX.assessments(spark, d))


@register("class_chart_feed", W_O(O.ASSESSMENTS) + ", st AS (" + STATS_SQL + "), lg AS ("
          + " UNION ALL ".join(f"SELECT {code} AS risk_category, '{name}' AS category_name, "
                               f"{name.lower().replace(' ', '_')}_count AS n, avg_risk_score AS mean_marker FROM st"
                               for code, name, _ in O.CLASSES)
          + ")\nSELECT risk_category, category_name, n, mean_marker, "
          + O.r6("n / sum(n) OVER () * 100e0") + " AS share_pct FROM lg WHERE n > 0")
def q_class_chart_feed(spark, d):
    return ST.class_chart_feed(ST.assessment_statistics(FX.assessments(spark, d)))


@register("quality_quarantine", W_O(O.ASSESSMENTS)
          + "SELECT id, risk_score, CASE WHEN assessment_date IS NULL THEN 'assessment_date is null' "
            "WHEN geom_wkt IS NULL THEN 'geometry is null' WHEN isnan(risk_score) THEN 'risk_score is NaN' "
            "ELSE 'risk_score outside 0..100' END AS reason FROM assessments "
            "WHERE assessment_date IS NULL OR geom_wkt IS NULL OR "
            "(risk_score IS NOT NULL AND (isnan(risk_score) OR risk_score < 0 OR risk_score > 100))")
def q_quality_quarantine(spark, d):
    _, bad = Q.split_valid(FX.assessments(spark, d))
    return bad.select("id", "risk_score", "reason")


# --------------------------------------------------------------------------- J-01, J-04


@register("spatial_join", W_O(O.ASSESSMENTS, O.BOUNDARIES)
          + "SELECT a.id, a.assessment_date, a.geom_wkt, a.risk_score, a.risk_category, a.area_hectares, "
            "b.boundary_id, b.nm AS boundary_name FROM assessments a LEFT JOIN boundaries b "
            "ON a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin "
            "ORDER BY a.assessment_date DESC, a.id, boundary_id")
def q_spatial_join(spark, d):
    a = FX.assessments(spark, d)
    b = FX.boundaries(spark, d)
    j = SP.spatial_left_join(a, b, "id", "boundary_id", ["nm"])
    out = j.select(*ASSESS_COLS, "boundary_id", F.col("nm").alias("boundary_name"))
    return out.orderBy(F.desc("assessment_date"), "id", "boundary_id")


@register("spatial_join_levels", W_O(O.ASSESSMENTS, O.POLYGONS)
          + "SELECT a.id, a.assessment_date, a.risk_score, z.id AS zone_id, z.nm AS zone_name FROM assessments a LEFT JOIN "
            "(SELECT id, nm, xmin, ymin, xmax, ymax FROM geoms JOIN bounds USING (kind, id) WHERE kind = 'zone') z "
            "ON a.xmin <= z.xmax AND a.xmax >= z.xmin AND a.ymin <= z.ymax AND a.ymax >= z.ymin ORDER BY assessment_date DESC, a.id, zone_id")
def q_spatial_join_levels(spark, d):
    """Boundaries that grow with the data, their bounding boxes up to 200 times as large as others'."""
    z = FX.zones(spark, d).drop("parts", "geom_wkt")
    j = SP.spatial_left_join(FX.assessments(spark, d).drop("ring"), z, "id", "zone_id", ["zone_name"],
                             order=[F.desc("assessment_date"), F.asc("id")])
    return j.select("id", "assessment_date", "risk_score", "zone_id", "zone_name").orderBy(F.desc("assessment_date"), "id", "zone_id")


INSIDE_SQL = ("SELECT s.id AS inner_id, e.id AS outer_id FROM starts s JOIN bounds b ON b.kind = {outer} AND s.x BETWEEN b.xmin AND b.xmax "
              "AND s.y BETWEEN b.ymin AND b.ymax JOIN edges e ON e.kind = b.kind AND e.id = b.id WHERE s.kind = {inner} "
              "GROUP BY s.id, s.x, s.y, e.id HAVING count(CASE WHEN " + O.ray_crosses("s.x", "s.y", "e") + " THEN 1 END) % 2 = 1")


@register("spatial_join_polygons", W_O(O.POLYGONS)
          + ", hits AS (SELECT DISTINCT a.id, b.id AS zone_id FROM edges a JOIN edges b ON a.kind = 'parcel' AND b.kind = 'zone' "
            "AND least(a.px, a.qx) <= greatest(b.px, b.qx) AND greatest(a.px, a.qx) >= least(b.px, b.qx) "
            "AND least(a.py, a.qy) <= greatest(b.py, b.qy) AND greatest(a.py, a.qy) >= least(b.py, b.qy) AND "
          + O.segments_meet("a", "b")
          + " UNION SELECT inner_id, outer_id FROM (" + INSIDE_SQL.format(inner="'parcel'", outer="'zone'") + ") i"
          + " UNION SELECT outer_id, inner_id FROM (" + INSIDE_SQL.format(inner="'zone'", outer="'parcel'") + ") o)\n"
            "SELECT p.id, zone_id, z.nm AS zone_name FROM geoms p LEFT JOIN hits USING (id) LEFT JOIN geoms z "
            "ON z.kind = 'zone' AND z.id = zone_id WHERE p.kind = 'parcel'")
def q_spatial_join_polygons(spark, d):
    """Polygons with holes, several parts and non-convex rings; touching counts."""
    return PG.polygon_left_join(FX.parcels(spark, d), FX.zones(spark, d), ["zone_id", "zone_name"]).select("id", "zone_id", "zone_name")


def _box_edge(x0, y0, x1, y1):
    return f"(SELECT {O.d(x0)} AS px, {O.d(y0)} AS py, {O.d(x1)} AS qx, {O.d(y1)} AS qy)"


SMALL_BOX = (150.1, -33.9, 150.13, -33.88)


@register("polygons_in_bbox", W_O(O.POLYGONS)
          + ", frame AS (" + " UNION ALL ".join(f"SELECT * FROM {_box_edge(*e)}" for e in (
              (SMALL_BOX[0], SMALL_BOX[1], SMALL_BOX[2], SMALL_BOX[1]), (SMALL_BOX[2], SMALL_BOX[1], SMALL_BOX[2], SMALL_BOX[3]),
              (SMALL_BOX[2], SMALL_BOX[3], SMALL_BOX[0], SMALL_BOX[3]), (SMALL_BOX[0], SMALL_BOX[3], SMALL_BOX[0], SMALL_BOX[1])))
          + "), hits AS (SELECT kind, id FROM edges JOIN frame ON " + O.segments_meet("edges", "frame")
          + f" UNION SELECT kind, id FROM starts WHERE x BETWEEN {O.d(SMALL_BOX[0])} AND {O.d(SMALL_BOX[2])} "
            f"AND y BETWEEN {O.d(SMALL_BOX[1])} AND {O.d(SMALL_BOX[3])} "
            f"UNION SELECT kind, id FROM edges GROUP BY kind, id HAVING count(CASE WHEN "
          + O.ray_crosses(O.d(SMALL_BOX[0]), O.d(SMALL_BOX[1]), "edges") + " THEN 1 END) % 2 = 1)\n"
            "SELECT kind, id, xmin, ymin, xmax, ymax FROM hits JOIN bounds USING (kind, id) ORDER BY kind, id")
def q_polygons_in_bbox(spark, d):
    z = FX.zones(spark, d).select(F.lit("zone").alias("kind"), F.col("zone_id").alias("id"), "parts", *SP.BOX)
    p = FX.parcels(spark, d).select(F.lit("parcel").alias("kind"), "id", "parts", *SP.BOX)
    found = SP.polygons_in_bbox(z.unionByName(p), SMALL_BOX).select("kind", "id", *SP.BOX)
    return stored(found).orderBy("kind", "id")  # a sort reads its rows twice


@register("orphan_pixels", W_O(O.GRID, O.ASSESSMENTS)
          + "SELECT count(*) AS child_rows, count(CASE WHEN g.assessment_id IS NOT NULL AND a.id IS NULL THEN 1 END) "
            "AS orphan_rows FROM grid g LEFT JOIN assessments a ON g.assessment_id = a.id")
def q_orphan_pixels(spark, d):
    child = grid(spark, d).select("assessment_id")
    parent = FX.assessments(spark, d).select(F.col("id").alias("assessment_id"), F.lit(True).alias("_has_parent"))
    j = child.join(parent, "assessment_id", "left")
    return j.agg(F.count(F.lit(1)).alias("child_rows"),
                 F.count_if(F.col("assessment_id").isNotNull() & F.col("_has_parent").isNull()).alias("orphan_rows"))


# --------------------------------------------------------------------------- P-21, P-24, P-25


@register("box_area", W_O(O.ASSESSMENTS)
          + f"SELECT id, (xmax - xmin) * (ymax - ymin) * {O.d(O.METRES)} * {O.d(O.METRES)} "
            "/ 10000e0 AS box_hectares FROM assessments")
def q_box_area(spark, d):
    a = FX.assessments(spark, d)
    return a.select("id", G.degree_box_hectares("xmin", "ymin", "xmax", "ymax").alias("box_hectares"))


@register("box_wkt_roundtrip", W_O(O.ASSESSMENTS)
          + ", parsed AS (SELECT id, geom_wkt, list_transform(string_split_regex(regexp_extract(geom_wkt, "
            "'\\(\\(\\s*([^()]*?)\\s*\\)', 1), '\\s*,\\s*'), lambda p: {'x': CAST(string_split_regex(trim(p), '\\s+')[1] AS DOUBLE), "
            "'y': CAST(string_split_regex(trim(p), '\\s+')[2] AS DOUBLE)}) AS ring FROM assessments)\n"
            "SELECT id, geom_wkt, CAST(len(ring) AS INTEGER) AS n_vertices, list_min(list_transform(ring, lambda p: p.x)) AS xmin, "
            "list_min(list_transform(ring, lambda p: p.y)) AS ymin, list_max(list_transform(ring, lambda p: p.x)) AS xmax, "
            "list_max(list_transform(ring, lambda p: p.y)) AS ymax FROM parsed")
def q_box_wkt_roundtrip(spark, d):
    a = FX.assessments(spark, d).select("id", "geom_wkt")
    r = a.withColumn("ring", G.wkt_ring("geom_wkt"))
    bb = G.ring_bbox("ring")
    return r.select("id", "geom_wkt", F.size("ring").alias("n_vertices"),
                    *[bb[k].alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])


@register("metadata_json", W_O(O.ASSESSMENTS)
          + "SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN CAST(json_object('scene', CAST(id AS VARCHAR)) AS VARCHAR) "
            "ELSE CAST(json_object('scene', CAST(id AS VARCHAR), 'processing_date', "
            "strftime(CAST(assessment_date AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')) AS VARCHAR) END AS metadata FROM assessments")
def q_metadata_json(spark, d):
    from ..sources.sinks import metadata_json
    a = FX.assessments(spark, d)
    ts = F.when(F.col("id") % 7 > 1, F.col("assessment_date").cast("timestamp"))
    scene = F.when(F.col("id") % 7 > 0, F.col("id"))
    return a.select("id", metadata_json(ts, {"scene": scene}).alias("metadata"))


# --------------------------------------------------------------------------- E-01 full assessment


@register("full_assessment", W_O(*O.MASKED_SCORED)
          + f", agg AS (SELECT avg(risk_score) AS m, avg(ndvi) AS ndvi_m, avg(ndmi) AS ndmi_m, avg(nbr) AS nbr_m, "
            "count(CASE WHEN risk_category >= 4 THEN 1 END) AS hi, count(CASE WHEN risk_category > 0 THEN 1 END) AS valid, "
            "count(*) AS n FROM mc)\n"
            f"SELECT {O.r6('m')} AS mean_risk_score, {O.cname(O.classify('m'))} AS risk_category, "
            f"{O.r6('ndvi_m')} AS ndvi_mean, {O.r6('ndmi_m')} AS ndmi_mean, {O.r6('nbr_m')} AS nbr_mean, "
            f"{O.r6('hi / n * 100e0')} AS high_risk_percentage, n AS total_pixels, valid AS valid_pixels, "
            f"({O.d(O.STUDY["E"])} - {O.d(O.STUDY["W"])}) * ({O.d(O.STUDY["N"])} - {O.d(O.STUDY["S"])}) * {O.d(O.METRES)} * {O.d(O.METRES)} "
            "/ 10000e0 AS area_hectares FROM agg")
def q_full_assessment(spark, d):
    from .assessment import scene_record
    return scene_record(masked_scored(spark, d), S.STUDY_AREA)


# --------------------------------------------------------------------------- S-02, S-05, S-06 files


NPY_CHUNK = 64


def _grid_npy_dir(spark, d) -> str:
    """Write the grid's fast-model risk map as ``.npy`` chunks (S-09) into a
    fresh folder of the shared checkpoint location; returns the folder."""
    from ..sources.arrays import scratch_dir, write_npy_chunks
    out = scratch_dir(spark, "risk-npy")
    write_npy_chunks(grid_fast(spark, d), out, NPY_CHUNK, ["risk_score"]).count()
    return out


@register("npy_scan", W_O(*O.GRID_FAST) + "SELECT CAST(px_row AS BIGINT) AS px_row, px_col, risk_score FROM gfs")
def q_npy_scan(spark, d):
    """Risk map written as array-file chunks by the raster sink, scanned back into pixel rows by the source."""
    rows = _risk_rasters(spark, d, grid_fast(spark, d), ["risk_score"])
    return rows.select("px_row", F.col("px_col").cast("int").alias("px_col"), "risk_score")


def _risk_rasters(spark, d, df, bands, tile=None, chunk=256):
    from ..sources.arrays import scratch_dir
    from ..sources.rasters import read_rasters, write_rasters
    out = scratch_dir(spark, "rasters")
    write_rasters(df, out, bands, tile, chunk)
    return read_rasters(spark, out, bands)


@register("raster_window", W_O(*O.GRID_FAST)
          + "SELECT CAST(px_row % 4 AS VARCHAR) AS tile, CAST(px_row AS BIGINT) AS px_row, CAST(px_col AS BIGINT) AS px_col, "
            "risk_score, ndvi_fast FROM gfs WHERE px_row % 4 IN (1, 2) AND px_row >= 5 AND px_row < 120 AND px_col <= 60")
def q_raster_window(spark, d):
    """Four interleaved (so sparse) tiles in array files; two of them and a window of rows and columns, pushed to the scan."""
    g = grid_fast(spark, d).withColumn("tile", F.col("px_row") % 4)
    rows = _risk_rasters(spark, d, g, ["risk_score", "ndvi_fast"], "tile", 128)
    return rows.where("tile IN ('1', '2') AND px_row >= 5 AND px_row < 120 AND px_col <= 60")


@register("tile_catalogue", W_O(O.GRID)
          + f"SELECT 'chunk_r' || CAST(cy * {NPY_CHUNK} AS VARCHAR) || '_c' || CAST(cx * {NPY_CHUNK} AS VARCHAR) "
            f"AS tile_name, CAST(128 + (max(px_row) - cy * {NPY_CHUNK} + 1) * (max(px_col) - cx * {NPY_CHUNK} + 1) * 8 "
            f"AS BIGINT) AS bytes FROM (SELECT *, CAST(floor(px_row / {NPY_CHUNK}) AS BIGINT) AS cy, "
            f"CAST(floor(px_col / {NPY_CHUNK}) AS BIGINT) AS cx FROM grid) g GROUP BY cy, cx")
def q_tile_catalogue(spark, d):
    """Tile files of the written risk map, listed without reading their bodies."""
    from ..sources.arrays import tile_catalogue
    return tile_catalogue(spark, _grid_npy_dir(spark, d), "*.npy").select("tile_name", "bytes")


@register("log_scan", W_O(*O.PIXEL_SCORED)
          + ", tm AS (SELECT tile_id, round(avg(risk_score), 2) AS m FROM pc GROUP BY tile_id)\n"
            f"SELECT count(*) AS tiles, count(m) AS scores, {O.r6('avg(m)')} AS avg_risk, "
            "min(m) AS min_risk, max(m) AS max_risk FROM tm")
def q_log_scan(spark, d):
    """Per-batch logs written from the tile means, then scanned and summarised."""
    from ..sources.arrays import read_tile_logs, scratch_dir, write_tile_logs
    means = ST.tile_means(pixel_scored(spark, d))
    batches = R.batch_assignment(means.select("tile_id"))
    out = scratch_dir(spark, "tile-logs")
    write_tile_logs(means, batches, out)
    return read_tile_logs(spark, out, glob="*.txt")


@register("quick_ndvi", W_O(O.GRID) + f"SELECT CAST(px_row AS BIGINT) AS px_row, px_col, {O.cindex('b08', 'b04')} AS ndvi FROM grid")
def q_quick_ndvi(spark, d):
    """Red and NIR written as separate array files, read back by band name and
    aligned on the pixel key by one aggregate (no join) before the index
    (P-05 / S-01 / J-05)."""
    from ..sources.arrays import scratch_dir
    from ..sources.bands import load_band_files
    from ..sources.rasters import write_rasters
    g = grid(spark, d)
    paths = {}
    for label, band in (("B04", "b04"), ("B08", "b08")):
        paths[label] = scratch_dir(spark, f"band-{band}")
        write_rasters(g.withColumn("value", F.col(band)), paths[label], ["value"], chunk_size=256)
    wide = load_band_files(spark, paths, ("tile", "px_row", "px_col"), "raster")
    return I.add_ndvi(wide).select("px_row", F.col("px_col").cast("int").alias("px_col"), "ndvi")


@register("marker_popups", W_O(*O.GRID_SCORED)
          + ", hr AS (SELECT *, row_number() OVER (ORDER BY px_row, px_col) - 1 AS idx, count(*) OVER () AS n "
            "FROM gc WHERE risk_category >= 4)\n"
            f"SELECT idx // greatest(1, n // {O.MARKERS}) AS sample_rank, "
            f"printf('%s hazard, score %.1f of 100, at latitude %.4f and longitude %.4f', {O.cname('risk_category')}, "
            f"risk_score, {LAT_SQL}, {LON_SQL}) AS popup FROM hr "
            f"WHERE idx % greatest(1, n // {O.MARKERS}) = 0")
def q_marker_popups(spark, d):
    """Marker feed with popup text (numbers formatted with one/four decimals)."""
    g = grid_scored(spark, d)
    height, width = grid_extent(g)
    return R.high_risk_markers(g, height, width, popup=True).select("sample_rank", "popup")


TOP_K = 10


@register("top_risk_assessments", W_O(O.ASSESSMENTS)
          + f"SELECT {ASSESS_SQL} FROM assessments WHERE risk_score IS NOT NULL "
            f"ORDER BY risk_score DESC, assessment_date DESC, id LIMIT {TOP_K}")
def q_top_risk_assessments(spark, d):
    """Top-k report of the highest scores (the limit is the feature)."""
    return SP.top_by_score(FX.assessments(spark, d), TOP_K).select(*ASSESS_COLS)


@register("tile_batch", W_O(O.PIXELS)
          + f", pi AS (SELECT tile_id, {O.cindex('b08', 'b04')} AS ndvi, {O.cindex('b08', 'b12')} AS nbr FROM pixels)"
            f", ps AS (SELECT *, {O.calibrated(present=('NDVI', 'NBR'))} AS risk_score FROM pi)\n"
            "SELECT CAST(tile_id AS VARCHAR) AS tile, CAST(count(*) AS BIGINT) AS pixels, round(avg(risk_score), 2) AS tile_mean_risk, "
            "min(risk_score) AS risk_min, max(risk_score) AS risk_max FROM ps GROUP BY tile_id ORDER BY tile")
def q_tile_batch(spark, d):
    """Two of the three indices over tile files that arrive in two lots; each run reads the new files only."""
    from ..sources.arrays import scratch_dir
    from . import tile_state as TS
    path, state = scratch_dir(spark, "tiles"), scratch_dir(spark, "tile-state")
    px = pixels(spark, d).withColumn("lot", F.col("tile_id"))
    for lot in ("tile_id < 6", "tile_id >= 6"):
        px.where(lot).write.mode("append").partitionBy("lot").parquet(path)
        TS.update(spark, path, state, ["NDVI", "NBR"])
    return TS.tile_totals(spark, path, state, ["NDVI", "NBR"]).orderBy("tile")


AREA_BOX = (150.15, -33.9, 150.45, -33.6)


@register("date_series_area", W_O(O.PIXELS)
          + ", scenes AS (SELECT tile_id, max(px_col) + 1 AS width, max(px_row) + 1 AS height FROM pixels GROUP BY tile_id)"
            f", pf AS (SELECT *, {O.findex('b08', 'b04')} AS ndvi_fast, {O.findex('b08', 'b11')} AS ndmi_fast, "
            f"{O.findex('b08', 'b12')} AS nbr_fast FROM pixels JOIN scenes USING (tile_id) "
            f"WHERE {O.d(TILE_W)} / width * px_col + 0e0 * px_row + ({O.d(W)} + (tile_id % 4) * {O.d(TILE_W)}) "
            f"BETWEEN {O.d(AREA_BOX[0])} AND {O.d(AREA_BOX[2])} AND 0e0 * px_col + {O.d(-TILE_H)} / height * px_row "
            f"+ ({O.d(N)} - floor(tile_id / 4) * {O.d(TILE_H)}) BETWEEN {O.d(AREA_BOX[1])} AND {O.d(AREA_BOX[3])})"
          + f", ps AS (SELECT *, {O.fast()} AS risk_score FROM pf)\n"
          + f"SELECT scene_date, {O.r6('avg(risk_score)')} AS mean_risk, max(risk_score) AS max_risk, "
            f"{O.r6(f'count(CASE WHEN risk_score > {O.d(O.SERIES)} THEN 1 END) / count(*) * 100e0')} AS high_risk_area, "
            "count(*) AS pixels FROM ps GROUP BY scene_date ORDER BY scene_date")
def q_date_series_area(spark, d):
    """Date series of the pixels of a study area, their rows and columns pushed to the scan."""
    px = pixels(spark, d)
    near = SCO.add_fast_score(I.add_fast_indices(AR.pixels_in_area(px, tile_scenes(px), AREA_BOX)))
    size = near.groupBy("scene_date").agg(F.count("*").alias("pixels"))
    return ST.time_series(near).join(size, "scene_date").orderBy("scene_date")


# --------------------------------------------------------------------------- E-08, S-08, S-14, E-09: what was written, read back


@register("save_assessment", W_O(*O.MASKED_SCORED)
          + f"SELECT date '2024-03-01' AS assessment_date, {O.r6('avg(risk_score)')} AS risk_score, "
            f"{O.cname(O.classify('avg(risk_score)'))} AS risk_category, {O.r6('avg(ndvi)')} AS ndvi_mean, {O.r6('avg(ndmi)')} AS ndmi_mean, "
            f"{O.r6('avg(nbr)')} AS nbr_mean, '{{\"tile\":\"' || CAST(tile_id AS VARCHAR) || '\"}}' AS metadata "
            "FROM mc GROUP BY tile_id HAVING avg(risk_score) IS NOT NULL ORDER BY metadata")
def q_save_assessment(spark, d):
    """One assessment a tile saved, saved again (nothing is added), and the table read back."""
    from ..sources.arrays import scratch_dir
    from ..sources.sinks import append_assessments
    from .assessment import assessment_record
    path = scratch_dir(spark, "assessments")
    tiles = assessment_record(masked_scored(spark, d), assessment_date="2024-03-01", processing_ts="2024-03-01 00:00:00", by=["tile_id"])
    records = stored(tiles.withColumn("metadata", F.to_json(F.struct(F.col("tile_id").cast("string").alias("tile"))))
                     .where("risk_score is not null").drop("id", "tile_id"))
    for _ in range(2):
        append_assessments(records, path)
    return spark.read.parquet(path).select(
        "assessment_date", ST.r6("risk_score").alias("risk_score"), "risk_category", *[ST.r6(c).alias(c) for c in (
            "ndvi_mean", "ndmi_mean", "nbr_mean")], "metadata").orderBy("metadata")


@register("saved_indices", W_O(O.PIXELS, O.idx("pixels", "pi"))
          + "SELECT tile_id, px_row, px_col, ndvi, nbr, scene_date FROM pi WHERE scene_date >= date '1998-06-01'")
def q_saved_indices(spark, d):
    """Index tables partitioned by scene date, written and read back for the dates asked for."""
    from ..sources.arrays import scratch_dir
    from ..sources.sinks import write_index_table
    path = scratch_dir(spark, "indices")
    write_index_table(I.add_all_indices(pixels(spark, d)), path, ["ndvi", "nbr"])
    return spark.read.parquet(path).where("scene_date >= date '1998-06-01'").select("tile_id", "px_row", "px_col", "ndvi", "nbr", "scene_date")


@register("map_legend", W_O(*O.GRID_SCORED)
          + f"SELECT risk_category, {O.cname('risk_category')} AS category_name, {O.ccolour('risk_category')} AS colour, count(*) AS pixels, "
            f"min(risk_score) AS least, max(risk_score) AS most FROM gc WHERE risk_category > 0 GROUP BY risk_category ORDER BY risk_category")
def q_map_legend(spark, d):
    """Legend of a risk map: the classes that occur, with colour, size and range of scores, by class."""
    g = grid_scored(spark, d).groupBy("risk_category").agg(F.count("*").alias("pixels"), F.min("risk_score").alias("least"),
                                                         F.max("risk_score").alias("most")).where("risk_category > 0")
    return g.select("risk_category", SC.category_name("risk_category").alias("category_name"), SC.category_colour("risk_category").alias("colour"),
                    "pixels", "least", "most").orderBy("risk_category")


@register("series_json", SERIES_SQL + " ORDER BY scene_date")
def q_series_json(spark, d):
    """The series exported as one JSON document of parallel lists, read back as rows."""
    from ..sources.arrays import scratch_dir
    from ..sources.sinks import write_series_json
    path = scratch_dir(spark, "series")
    arrays = ST.series_arrays(series(spark, d))
    write_series_json(arrays, path)
    back = spark.read.schema(arrays.schema).json(path)
    rows = back.select(F.explode(F.arrays_zip("dates", "mean_risks", "max_risks", "high_risk_areas")).alias("r"))
    return rows.select(F.col("r.dates").alias("scene_date"), F.col("r.mean_risks").alias("mean_risk"), F.col("r.max_risks").alias("max_risk"),
                       F.col("r.high_risk_areas").alias("high_risk_area")).orderBy("scene_date")


@register("map_layers", W_O(*O.GRID_SCORED)
          + f"SELECT px_row, px_col, risk_category, {O.cname('risk_category')} AS category_name, "
            f"coalesce({O.ccolour('risk_category')}, '#000000') AS colour, CASE WHEN risk_category = 0 THEN 0 ELSE 255 END AS alpha, "
            f"{LAT_SQL} AS north, {LON_SQL} AS west FROM gc")
def q_map_layers(spark, d):
    """The class layer of a risk map: colour, opacity and upper left corner of every pixel."""
    g = grid_scored(spark, d)
    at = g.withColumns(_lat_lon(g))
    return at.select(*GRID_KEYS, "risk_category", SC.category_name("risk_category").alias("category_name"),
                     F.coalesce(SC.category_colour("risk_category"), F.lit("#000000")).alias("colour"),
                     F.when(F.col("risk_category") == 0, F.lit(0)).otherwise(F.lit(255)).alias("alpha"),
                     F.col("lat").alias("north"), F.col("lon").alias("west"))
