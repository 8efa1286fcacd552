"""Pixels of a study area, found by rows and columns.

A box in map coordinates is turned into a range of rows and columns of each
scene by the inverse of the scene's affine transform. The least and greatest
of them are plain comparisons on the key columns and reach the scan (Parquet
row groups and array files outside them are not read); each scene's own range
follows in the join with the stored scene catalogue, and the exact test on
the transformed coordinates last. Rotated scenes are covered: the range is
that of the box's four corners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import affine_x, affine_y
from ..sources.tables import stored


def pixel_ranges(scenes: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """``scenes`` (transform ``a..f``, ``width``, ``height``) that the closed box reaches, with ``r0, r1, c0, c1``.

    Ranges are one pixel wider than computed, against rounding. Scenes without an invertible transform raise.
    """
    west, south, east, north = (float(v) for v in box)
    det = F.expr("a * e - b * d")
    checked = F.when(det != 0, det).otherwise(F.raise_error(F.lit("a scene's transform cannot be inverted")).cast("double"))
    df = scenes.withColumn("_det", checked)
    cols, rows = [], []
    for x, y in ((west, south), (east, south), (east, north), (west, north)):
        dx, dy = F.lit(x) - F.col("c"), F.lit(y) - F.col("f")
        cols.append((F.col("e") * dx - F.col("b") * dy) / F.col("_det"))
        rows.append((F.col("a") * dy - F.col("d") * dx) / F.col("_det"))
    df = df.withColumns({"r0": F.floor(F.least(*rows)) - 1, "r1": F.ceil(F.greatest(*rows)) + 1,
                         "c0": F.floor(F.least(*cols)) - 1, "c1": F.ceil(F.greatest(*cols)) + 1}).drop("_det")
    return df.where("r1 >= 0 AND c1 >= 0 AND r0 < height AND c0 < width")


def pixels_in_area(px: DataFrame, scenes: DataFrame, box: tuple[float, float, float, float], key: str = "tile_id",
                   row: str = "px_row", col: str = "px_col") -> DataFrame:
    """Pixels whose corner lies in the closed box, with their coordinates ``x`` and ``y``.

    ``scenes`` has one row for each value of ``key``; pixels of unknown scenes lie nowhere. One row of four numbers
    reaches the driver.
    """
    west, south, east, north = (float(v) for v in box)
    ranges = stored(pixel_ranges(scenes.select(key, "width", "height", *"abcdef"), box))
    span = ranges.agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).first()
    if span.r0 is None:
        near = px.where(F.lit(False))
    else:
        near = px.where((F.col(row) >= int(span.r0)) & (F.col(row) <= int(span.r1)) & (F.col(col) >= int(span.c0)) & (F.col(col) <= int(span.c1)))
    kept = near.join(ranges.drop("width", "height").withColumnsRenamed({c: f"_{c}" for c in ("r0", "r1", "c0", "c1", *"abcdef")}), key)
    kept = kept.where(F.col(row).between(F.col("_r0"), F.col("_r1")) & F.col(col).between(F.col("_c0"), F.col("_c1")))
    kept = kept.withColumns({"x": affine_x(col, row, "_a", "_b", "_c"), "y": affine_y(col, row, "_d", "_e", "_f")})
    return kept.where(F.col("x").between(west, east) & F.col("y").between(south, north)).select(*px.columns, "x", "y")
