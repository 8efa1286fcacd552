"""Pixel, grid, assessment and boundary tables derived from the driver tables.

These are the shapes the hazard engine works on, obtained by column
expressions over the TPC-H-style Parquet files so that every query's work
grows with the data:

* ``pixels``      -- one row per (tile, row, col, scene date) with four bands and
                     a scene-classification code; not keyed (lineitem).
* ``grid``        -- one dense, uniquely keyed raster, width 100 (orders).
* ``assessments`` -- one rectangle per customer in/around the study area.
* ``boundaries``  -- a 5 x 5 grid of named cells over the study area.
* ``zones``       -- one named polygon per supplier: rectangles, holes, two parts, U shapes;
                     two of a hundred are 200 times as large as the others.
* ``parcels``     -- one small polygon per customer: rectangles, triangles, two parts, holes.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import box_ring, box_wkt, parts_bbox, parts_wkt, wkt_parts
from ..functions.scores import category_name, classify
from .tables import read_table

GRID_WIDTH = 100


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    dead = (F.col("l_partkey") % 97) == 0
    return li.select(
        (F.col("l_suppkey") % 16).alias("tile_id"),
        F.col("l_orderkey").alias("px_row"),
        F.col("l_linenumber").alias("px_col"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("scene_date"),
        F.when(dead, F.lit(0.0)).otherwise(F.lit(500.0) + F.col("l_quantity") * F.lit(50.0)).alias("b04"),
        F.when(dead, F.lit(0.0)).otherwise(F.lit(300.0) + F.col("l_extendedprice") % F.lit(7000.0)).alias("b08"),
        (F.lit(800.0) + F.col("l_discount") * F.lit(30000.0)).alias("b11"),
        (F.lit(600.0) + F.col("l_tax") * F.lit(30000.0)).alias("b12"),
        (F.col("l_partkey") % 12).cast("int").alias("scl"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.floor(k / F.lit(GRID_WIDTH)).cast("int").alias("px_row"),
        (k % GRID_WIDTH).cast("int").alias("px_col"),
        (F.lit(500.0) + F.col("o_totalprice") % F.lit(2500.0)).alias("b04"),
        (F.lit(300.0) + (F.col("o_totalprice") * F.lit(7.0)) % F.lit(7000.0)).alias("b08"),
        (F.lit(800.0) + F.col("o_custkey") % 3000).alias("b11"),
        (F.lit(600.0) + (k * 31) % 2400).alias("b12"),
        F.col("o_custkey").alias("assessment_id"),
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    side = F.lit(10) * (F.lit(1) + key % 3)
    x0i = F.lit(150000) + (key % 80) * 10
    y0i = F.lit(-34000) + (key % 50) * 10
    score = F.when(key % 101 == 0, F.lit(None).cast("double")).otherwise(
        (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(105.0))
    df = c.select(
        key.alias("id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int")).alias("assessment_date"),
        (x0i / F.lit(1000.0)).alias("xmin"),
        (y0i / F.lit(1000.0)).alias("ymin"),
        ((x0i + side) / F.lit(1000.0)).alias("xmax"),
        ((y0i + side) / F.lit(1000.0)).alias("ymax"),
        score.alias("risk_score"),
        (side * side * F.lit(1232.1)).alias("area_hectares"),
    )
    return df.select(
        "id", "assessment_date",
        box_wkt("xmin", "ymin", "xmax", "ymax").alias("geom_wkt"),
        "xmin", "ymin", "xmax", "ymax",
        box_ring("xmin", "ymin", "xmax", "ymax").alias("ring"),
        "risk_score",
        category_name(classify("risk_score")).alias("risk_category"),
        "area_hectares",
    )


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x0i = F.lit(150000) + (k % 5) * 160
    y0i = F.lit(-34000) + F.floor(k / F.lit(5)) * 100
    df = n.select(
        k.cast("long").alias("boundary_id"),
        F.col("n_name").alias("nm"),
        (x0i / F.lit(1000.0)).alias("xmin"),
        (y0i / F.lit(1000.0)).alias("ymin"),
        ((x0i + 160) / F.lit(1000.0)).alias("xmax"),
        ((y0i + 100) / F.lit(1000.0)).alias("ymax"),
    )
    return df.withColumn("ring", box_ring("xmin", "ymin", "xmax", "ymax"))




# Shapes as parts, rings and corners, in steps of a polygon's own scale.
ZONE_SHAPES = [
    [[[(0, 0), (4, 0), (4, 4), (0, 4)]]],
    [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]],
    [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(2, 2), (4, 2), (4, 4)]]],
    [[[(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)]]],
]
PARCEL_SHAPES = [
    [[[(0, 0), (1, 0), (1, 1), (0, 1)]]],
    [[[(0, 0), (2, 0), (0, 2)]]],
    [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(3, 3), (4, 3), (4, 4), (3, 4)]]],
    [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]],
]


def _placed(df: DataFrame, shapes, kind, x0i, y0i, scale) -> DataFrame:
    """``df`` with ``parts``: the shape of number ``kind`` at a corner, in thousandths of a degree."""
    points = [[[[{"x": x, "y": y} for x, y in [*ring, ring[0]]] for ring in part] for part in parts] for parts in shapes]
    text = F.from_json(F.lit(json.dumps(points)), "array<array<array<array<struct<x:int,y:int>>>>>")
    df = df.withColumns({"_shape": F.get(text, kind.cast("int")), "_x": x0i, "_y": y0i, "_scale": scale})
    point = "named_struct('x', (_x + p.x * _scale) / 1000D, 'y', (_y + p.y * _scale) / 1000D)"
    parts = F.expr(f"transform(_shape, part -> transform(part, ring -> transform(ring, p -> {point})))")
    return df.select("*", _once(parts).alias("parts")).drop("_shape", "_x", "_y", "_scale")


def _once(value):
    """A value computed once a row, as if read from a table: filters on it are not pushed below a generator."""
    return F.explode(F.array(value))


def _bounded(df: DataFrame) -> DataFrame:
    box = F.struct(*[v.alias(k) for k, v in parts_bbox("parts").items()])
    return df.select("*", _once(box).alias("_box")).select(*df.columns, "_box.*")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    scale = (F.lit(5) + (k % 5) * 5) * F.when(k % 50 == 7, F.lit(200)).otherwise(F.lit(1))
    back = F.when(k % 50 == 7, scale * 2).otherwise(F.lit(0))
    x0i, y0i = F.lit(150000) + (k * 37) % 97 * 10 - back, F.lit(-34000) + (k * 53) % 61 * 10 - back
    df = _placed(s.select(k.alias("zone_id"), F.col("s_name").alias("zone_name"), k), ZONE_SHAPES, k % 4, x0i, y0i, scale)
    df = df.select("zone_id", "zone_name", _once(parts_wkt("parts")).alias("geom_wkt"))
    return _bounded(df.select("*", _once(wkt_parts("geom_wkt")).alias("parts")))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    scale = F.lit(2) + (k % 3) * 4
    x0i, y0i = F.lit(150000) + (k % 83) * 12, F.lit(-34000) + (k % 59) * 11
    return _bounded(_placed(c.select(k.alias("id"), k), PARCEL_SHAPES, k % 4, x0i, y0i, scale).drop("c_custkey"))
