"""Fixed values of the hazard model, dimension tables and table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the model's published constants for results
# to agree; they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# Risk classes: code, name, lower bound (inclusive), colour.
CATEGORY_ROWS = [
    (1, "Very Low", 0.0, "#2E8B57"),
    (2, "Low", 20.0, "#FFD700"),
    (3, "Moderate", 40.0, "#FF8C00"),
    (4, "High", 60.0, "#FF4500"),
    (5, "Very High", 80.0, "#DC143C"),
]
UNKNOWN_NAME = "Unknown"          # name of code 0 (no data) and of anything else
CLASS_THRESHOLDS = (20.0, 40.0, 60.0, 80.0)

# Default index weights of the calibrated model (normalised by their sum).
DEFAULT_WEIGHTS = {"NDVI": 0.3, "NDMI": 0.5, "NBR": 0.2}
# Weights of the fast model (used as given, never renormalised).
FAST_WEIGHTS = {"NDVI": 0.3, "NDMI": 0.5, "NBR": 0.2}
FAST_EPSILON = 1e-10

# Index definitions: name -> (positive band, negative band).
INDEX_BANDS = {
    "NDVI": ("b08", "b04"),
    "NDMI": ("b08", "b11"),
    "NBR": ("b08", "b12"),
}
# Health rescaling of the calibrated model: index -> (offset, span).
# health = clip((x + offset) / span * 100, 0, 100); component = 100 - health.
HEALTH_SCALE = {
    "NDVI": (0.1, 0.9),
    "NDMI": (0.2, 0.8),
    "NBR": (1.0, 2.0),
}

# Scene-classification codes that mark a pixel as no data
# (no data, saturated, cloud shadow, cloud medium, cloud high, thin cirrus).
MASKED_SCL_CODES = (0, 1, 3, 8, 9, 10)

# Default pixel footprint (10 m pixels) and degree-to-metre factor.
PIXEL_AREA_M2 = 100.0
METRES_PER_DEGREE = 111000.0

# Study area of the demo scene: min_lon, min_lat, max_lon, max_lat.
STUDY_AREA = (150.0, -34.0, 150.8, -33.5)

# Series threshold: share of pixels with score strictly above this value.
SERIES_HIGH_RISK = 60.0
# Marker sampling: at most about this many systematic markers.
MARKER_TARGET = 20
# Tiles per batch of the tile batch report.
TILES_PER_BATCH = 4

BANDS = ("b04", "b08", "b11", "b12")
BAND_NAMES = {"B04": "b04", "B08": "b08", "B11": "b11", "B12": "b12"}

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------

PIXEL_SCHEMA = T.StructType([
    T.StructField("tile_id", T.LongType()),
    T.StructField("px_row", T.LongType()),
    T.StructField("px_col", T.IntegerType()),
    T.StructField("scene_date", T.DateType()),
    T.StructField("b04", T.DoubleType()),
    T.StructField("b08", T.DoubleType()),
    T.StructField("b11", T.DoubleType()),
    T.StructField("b12", T.DoubleType()),
    T.StructField("scl", T.IntegerType()),
])

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

ASSESSMENT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("assessment_date", T.DateType(), False),
    T.StructField("geom_wkt", T.StringType(), False),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
    T.StructField("ring", T.ArrayType(POINT)),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_category", T.StringType()),
    T.StructField("ndvi_mean", T.DoubleType()),
    T.StructField("ndmi_mean", T.DoubleType()),
    T.StructField("nbr_mean", T.DoubleType()),
    T.StructField("area_hectares", T.DoubleType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

PIXEL_RESULT_SCHEMA = T.StructType([
    T.StructField("assessment_id", T.LongType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("risk_category", T.IntegerType()),
    T.StructField("ndvi", T.DoubleType()),
    T.StructField("ndmi", T.DoubleType()),
    T.StructField("nbr", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
])


def _values(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A literal relation built JVM-side (no Python serialisation)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return repr(v) + ("" if "e" in repr(v) else "D")
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def category_dim(spark: SparkSession) -> DataFrame:
    """Five-row class dimension (code, name, lower bound, hex colour).

    Fixed size, so broadcasting it is always safe.
    """
    return _values(spark, CATEGORY_ROWS, "risk_category, category_name, lower_bound, colour")


def palette_rows(n: int = 256):
    """A sequential yellow-to-red ramp of ``n`` RGB steps, built from a rule.

    Integer arithmetic only, so the same rule written in SQL gives the same
    colours (see ``functions.colour.ramp_rgb``).
    """
    last = n - 1
    return [(i, 255, 230 - (210 * i) // last, (60 * (last - i)) // last) for i in range(n)]


def palette_dim(spark: SparkSession, n: int = 256) -> DataFrame:
    """Palette as data (``bucket, r, g, b``); fixed size ``n``, safe to broadcast."""
    return _values(spark, palette_rows(n), "bucket, r, g, b")
