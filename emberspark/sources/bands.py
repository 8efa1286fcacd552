"""Band layouts: long (one row per pixel and band) <-> wide (one column per band).

Wide is the working layout (no join needed to combine bands). A long band
table -- one file per band, as rasters are usually delivered -- is aligned by
pivoting on the pixel key: one shuffle on that key, with the band list fixed
up front so Spark does not scan for distinct values first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

BAND_LABELS = tuple(S.BAND_NAMES)          # B04, B08, B11, B12
#: Bytes of array files in a task that aligns bands: it holds a group for each of its pixels, some 400 bytes for the 8 of
#: a dense file, before any meet those of another band.
ALIGN_BYTES = 8 << 20


def wide_to_long(df: DataFrame, keys: list[str], bands=S.BANDS) -> DataFrame:
    present = [b for b in bands if b in df.columns]
    long = df.unpivot(keys, present, "band", "value")
    return long.withColumn("band", F.upper("band"))


def long_to_wide(long: DataFrame, keys: list[str], labels=BAND_LABELS) -> DataFrame:
    """Pivot a ``(keys..., band, value)`` table to one column per band.

    A pixel missing a band gets NULL there (no data), not a dropped row.
    """
    # Conditional aggregation = pivot with a fixed value list, without the
    # pivot-first rewrite; partial aggregation combines map-side.
    return long.groupBy(*keys).agg(*[one_value(lbl).alias(S.BAND_NAMES[lbl]) for lbl in labels])


def one_value(label: str):
    """The value of a band within a pixel; an error if the pixel has several
    (two tiles or files under one key), rather than a choice among them."""
    here = F.col("band") == F.lit(label)
    several = F.raise_error(F.lit(f"several values of band {label} for one pixel key")).cast("double")
    return F.when(F.count_if(here) > 1, several).otherwise(F.max(F.when(here, F.col("value"))))


def alignment_report(long: DataFrame, keys: list[str], labels=BAND_LABELS) -> DataFrame:
    """Pixels whose band set is incomplete or duplicated (expected: none)."""
    per_px = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.count_distinct("band").alias("bands"))
    return per_px.where((F.col("n") != len(labels)) | (F.col("bands") != len(labels)))


def scene_metadata(px: DataFrame, key: str = "tile_id", origin_lon=None, origin_lat=None,
                   pixel_w=None, pixel_h=None, crs: str = "EPSG:4326") -> DataFrame:
    """Per-scene raster metadata: width/height from the data and an affine
    transform ``x = a*col + b*row + c``, ``y = d*col + e*row + f`` (north-up,
    so ``e`` is negative). ``origin_*``/``pixel_*`` are columns or literals.

    One row per scene: joined back to pixels it is broadcast by AQE's size
    check, not by a hint.
    """
    meta = px.groupBy(key).agg((F.max("px_col") + 1).alias("width"), (F.max("px_row") + 1).alias("height"))

    def c(v, default):
        v = default if v is None else v
        return v if not isinstance(v, (int, float)) else F.lit(float(v))

    return meta.select(
        key, "width", "height",
        c(pixel_w, 1.0).alias("a"), F.lit(0.0).alias("b"), c(origin_lon, 0.0).alias("c"),
        F.lit(0.0).alias("d"), (-c(pixel_h, 1.0)).alias("e"), c(origin_lat, 0.0).alias("f"),
        F.lit(crs).alias("crs"))


def load_band_files(spark, band_paths: dict, keys=("px_row", "px_col"), reader: str = "npy") -> DataFrame:
    """Multi-band scan from one file set per band (``{"B04": path, ...}``).

    Each band is read as ``(keys..., value)`` rows and tagged with its label;
    the union is aligned into the wide layout by a single pivot on the pixel
    key (one shuffle for any number of bands, instead of one join per band).
    ``reader`` is ``"raster"`` (the array file source, whose key has the tile
    too), ``"npy"`` (array files of one tile) or ``"parquet"`` (tables with
    the key columns and a ``value`` column).
    """
    from functools import reduce

    from .arrays import read_npy
    from .rasters import read_rasters
    keys = list(keys)
    parts = []
    for label, path in band_paths.items():
        if reader == "raster":
            df = read_rasters(spark, path, bands=("value",), partition_bytes=ALIGN_BYTES).select(*keys, "value")
        elif reader == "npy":
            df = read_npy(spark, path, bands=("value",)).select(*keys, "value")
        elif reader == "parquet":
            df = spark.read.parquet(path).select(*keys, F.col("value").cast("double"))
        else:
            raise ValueError(f"unknown band reader {reader!r}")
        parts.append(df.withColumn("band", F.lit(label.upper())))
    long = reduce(lambda a, b: a.unionByName(b), parts)
    labels = [lbl.upper() for lbl in band_paths]
    wide = long.groupBy(*keys).agg(*[one_value(lbl).alias(S.BAND_NAMES.get(lbl, lbl.lower())) for lbl in labels])
    return wide
