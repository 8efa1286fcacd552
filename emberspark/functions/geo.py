"""Geometry as plain columns: bounding boxes, WKT rings, pixel coordinates.

Spark ships no geometry predicates, so a polygon is carried as top-level
``xmin, ymin, xmax, ymax`` (pushable to Parquet row-group statistics) plus a
``ring`` ``ARRAY<STRUCT<x, y>>`` for the exact test; WKT is the interchange
text. All predicates are closed: touching edges and corners count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .core import col


# --------------------------------------------------------------------------- WKT

def box_wkt(xmin, ymin, xmax, ymax) -> Column:
    """Axis-parallel rectangle as WKT, counter-clockwise from the lower left."""
    x0, y0, x1, y1 = (col(c).cast("string") for c in (xmin, ymin, xmax, ymax))
    sp, cm = F.lit(" "), F.lit(", ")
    return F.concat(F.lit("POLYGON(("),
                    x0, sp, y0, cm, x1, sp, y0, cm, x1, sp, y1, cm,
                    x0, sp, y1, cm, x0, sp, y0, F.lit("))"))


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    x0, y0, x1, y1 = (col(c) for c in (xmin, ymin, xmax, ymax))

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))


def wkt_ring(wkt) -> Column:
    """The ring of a ``POLYGON((x y, ...))`` WKT as ``ARRAY<STRUCT<x, y>>``.

    A polygon with holes and a multi-part polygon cannot be held by one ring and raise.
    """
    several = col(wkt).rlike(r"(?i)MULTI|\)\s*,\s*\(")
    body = F.regexp_extract(col(wkt), r"\(\(\s*([^()]*?)\s*\)", 1)
    pts = F.split(body, r"\s*,\s*")

    def to_point(p):
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(xy.getItem(0).cast("double").alias("x"),
                        xy.getItem(1).cast("double").alias("y"))

    refused = F.raise_error(F.concat(F.lit("polygon of several rings: "), col(wkt))).cast("array<struct<x:double,y:double>>")
    return F.when(several, refused).when(F.length(body) > 0, F.transform(pts, to_point))


def ring_bbox(ring) -> dict[str, Column]:
    r = col(ring)
    return {
        "xmin": F.array_min(F.transform(r, lambda p: p["x"])),
        "ymin": F.array_min(F.transform(r, lambda p: p["y"])),
        "xmax": F.array_max(F.transform(r, lambda p: p["x"])),
        "ymax": F.array_max(F.transform(r, lambda p: p["y"])),
    }


def is_box(ring, xmin, ymin, xmax, ymax) -> Column:
    """True when the ring is exactly its own bounding rectangle."""
    r = col(ring)
    x0, y0, x1, y1 = (col(c) for c in (xmin, ymin, xmax, ymax))
    corner = F.forall(r, lambda p: ((p["x"] == x0) | (p["x"] == x1)) & ((p["y"] == y0) | (p["y"] == y1)))

    def at(i, k):
        return F.get(r, F.lit(i))[k]

    def step(i):  # from one corner to the next, exactly one coordinate changes
        return (at(i, "x") == at(i + 1, "x")) != (at(i, "y") == at(i + 1, "y"))

    def turn(i):  # and a side is not walked back
        return (at(i, "x") != at(i + 2, "x")) & (at(i, "y") != at(i + 2, "y"))

    flat = (x0 == x1) | (y0 == y1)
    walk = step(0) & step(1) & step(2) & step(3) & turn(0) & turn(1) & turn(2)
    return F.coalesce((F.size(r) == 5) & corner & (flat | walk), F.lit(False))


# --------------------------------------------------------------------------- parts: several rings


def box_parts(xmin, ymin, xmax, ymax) -> Column:
    """A rectangle as a geometry of one part."""
    return F.array(F.array(box_ring(xmin, ymin, xmax, ymax)))


def wkt_parts(wkt) -> Column:
    """``POLYGON`` or ``MULTIPOLYGON`` text as parts: polygons, each its outer ring and then its holes, each ring its
    points ``STRUCT<x, y>``. NULL for NULL, an empty geometry and other text."""
    many = F.regexp_replace(F.trim(col(wkt)), r"(?i)^POLYGON\s*(\(.*\))$", "MULTIPOLYGON($1)")
    body = F.regexp_extract(many, r"(?i)^MULTIPOLYGON\s*\(\s*\(\s*\((.*)\)\s*\)\s*\)$", 1)

    def point(p):
        xy = F.split(F.trim(p), r"\s+")
        return F.struct(xy.getItem(0).cast("double").alias("x"), xy.getItem(1).cast("double").alias("y"))

    def ring(r):
        return F.transform(F.split(r, ","), point)

    def part(p):
        return F.transform(F.split(p, r"\)\s*,\s*\("), ring)

    return F.when(F.length(body) > 0, F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), part))


def parts_wkt(parts) -> Column:
    """Parts as ``POLYGON`` (one part) or ``MULTIPOLYGON`` text."""
    def ring(r):
        return F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit(")"))

    def part(p):
        return F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))

    p = col(parts)
    return F.when(F.size(p) == 1, F.concat(F.lit("POLYGON"), part(F.get(p, F.lit(0))))).when(
        F.size(p) > 1, F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(p, part), ", "), F.lit(")")))


def parts_bbox(parts) -> dict[str, Column]:
    return ring_bbox(F.flatten(F.flatten(col(parts))))


def parts_is_box(parts, xmin, ymin, xmax, ymax) -> Column:
    """True when the geometry is one ring that is its own bounding rectangle."""
    p = col(parts)
    only = F.get(F.get(p, F.lit(0)), F.lit(0))
    return F.coalesce((F.size(p) == 1) & (F.size(F.get(p, F.lit(0))) == 1) & is_box(only, xmin, ymin, xmax, ymax), F.lit(False))


# --------------------------------------------------------------------------- areas

def degree_box_hectares(xmin, ymin, xmax, ymax, metres_per_degree: float = S.METRES_PER_DEGREE) -> Column:
    """Rough box area: degrees x 111 km, no latitude correction (as published)."""
    m = F.lit(metres_per_degree)
    return (col(xmax) - col(xmin)) * (col(ymax) - col(ymin)) * m * m / F.lit(10000.0)


# --------------------------------------------------------------------------- predicates


_ORIENT = "sign(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
_ONSEG = ("({r}.x BETWEEN least({p}.x, {q}.x) AND greatest({p}.x, {q}.x) AND "
          "{r}.y BETWEEN least({p}.y, {q}.y) AND greatest({p}.y, {q}.y))")


def _edges_sql(ring: str) -> str:
    return (f"transform(sequence(1, size({ring}) - 1), "
            f"i -> named_struct('p', {ring}[i - 1], 'q', {ring}[i]))")


def _segments_touch_sql(e: str, f: str) -> str:
    p1, q1, p2, q2 = f"{e}.p", f"{e}.q", f"{f}.p", f"{f}.q"
    o1 = _ORIENT.format(p=p1, q=q1, r=p2)
    o2 = _ORIENT.format(p=p1, q=q1, r=q2)
    o3 = _ORIENT.format(p=p2, q=q2, r=p1)
    o4 = _ORIENT.format(p=p2, q=q2, r=q1)
    return (f"(({o1} != {o2} AND {o3} != {o4})"
            f" OR ({o1} = 0 AND {_ONSEG.format(p=p1, q=q1, r=p2)})"
            f" OR ({o2} = 0 AND {_ONSEG.format(p=p1, q=q1, r=q2)})"
            f" OR ({o3} = 0 AND {_ONSEG.format(p=p2, q=q2, r=p1)})"
            f" OR ({o4} = 0 AND {_ONSEG.format(p=p2, q=q2, r=q1)}))")


def _point_in_ring_sql(pt: str, ring: str) -> str:
    """Even-odd ray cast of ``pt`` against ``ring`` (boundary handled by edges)."""
    cross = (f"((e.p.y > {pt}.y) != (e.q.y > {pt}.y)) AND "
             f"({pt}.x < (e.q.x - e.p.x) * ({pt}.y - e.p.y) / (e.q.y - e.p.y) + e.p.x)")
    return (f"aggregate({_edges_sql(ring)}, false, "
            f"(acc, e) -> CASE WHEN {cross} THEN NOT acc ELSE acc END)")


def rings_intersect_sql(ring_a: str, ring_b: str) -> str:
    """Exact closed intersects of two simple polygons given as ring columns.

    Some edge of A touches/crosses some edge of B, or one polygon lies inside
    the other (then its first vertex is inside the other ring).
    """
    edges = (f"exists({_edges_sql(ring_a)}, ea -> exists({_edges_sql(ring_b)}, eb -> "
             f"{_segments_touch_sql('ea', 'eb')}))")
    return (f"({edges} OR {_point_in_ring_sql(ring_a + '[0]', ring_b)}"
            f" OR {_point_in_ring_sql(ring_b + '[0]', ring_a)})")


def parts_edges_sql(parts: str) -> str:
    """All edges of a geometry's rings."""
    return f"flatten(transform(filter(flatten({parts}), r -> size(r) > 1), r -> {_edges_sql('r')}))"


def parts_meet_box(parts: str, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Exact closed intersection of a geometry with a fixed rectangle.

    An edge meets a side of the rectangle, or a part starts inside it, or it lies inside the geometry (even-odd
    over all rings, so not in a hole).
    """
    corner = [f"named_struct('x', {x!r}D, 'y', {y!r}D)" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    sides = "array(" + ", ".join(f"named_struct('p', {p}, 'q', {q})" for p, q in zip(corner, corner[1:])) + ")"
    edges = parts_edges_sql(parts)
    meets = f"exists({edges}, e -> exists({sides}, s -> {_segments_touch_sql('e', 's')}))"
    starts = (f"exists({parts}, t -> size(t) > 0 AND size(t[0]) > 0 AND t[0][0].x BETWEEN {x0!r}D AND {x1!r}D "
              f"AND t[0][0].y BETWEEN {y0!r}D AND {y1!r}D)")
    around = (f"aggregate({edges}, false, (acc, e) -> CASE WHEN ((e.p.y > {y0!r}D) != (e.q.y > {y0!r}D)) AND "
              f"({x0!r}D < (e.q.x - e.p.x) * ({y0!r}D - e.p.y) / (e.q.y - e.p.y) + e.p.x) THEN NOT acc ELSE acc END)")
    return F.expr(f"coalesce({starts} OR {meets} OR {around}, false)")


def rings_intersect(ring_a: str, ring_b: str) -> Column:
    return F.expr(rings_intersect_sql(ring_a, ring_b))


# --------------------------------------------------------------------------- pixel coordinates

def pixel_lat(px_row, height, south: float, north: float) -> Column:
    """Row 0 is the northern edge; linear interpolation inside the bounds."""
    return F.lit(south) + F.lit(north - south) * (F.lit(1.0) - col(px_row) / col(height))


def pixel_lon(px_col, width, west: float, east: float) -> Column:
    return F.lit(west) + F.lit(east - west) * (col(px_col) / col(width))


def affine_x(px_col, px_row, a, b, c) -> Column:
    return col(a) * col(px_col) + col(b) * col(px_row) + col(c)


def affine_y(px_col, px_row, d, e, f) -> Column:
    return col(d) * col(px_col) + col(e) * col(px_row) + col(f)
