"""Independent SQL twins of the catalogue queries (DuckDB dialect).

Each string runs against the driver's tables registered as views
(``lineitem``, ``orders``, ``customer``, ``nation`` ...). The four derived
shapes are spelled out as CTEs; score arithmetic is written in the same
operation order as the Spark expressions so per-row doubles agree bit for
bit, and every aggregate that sums floats is rounded to 6 places.
"""

from __future__ import annotations

# The model's fixed values, written out here so that a wrong one in the engine shows.
WEIGHTS = {"NDVI": 0.3, "NDMI": 0.5, "NBR": 0.2}
EPSILON = 1e-10
HEALTH = {"NDVI": (0.1, 0.9), "NDMI": (0.2, 0.8), "NBR": (1.0, 2.0)}
THRESHOLDS = (20.0, 40.0, 60.0, 80.0)
CLASSES = [(1, "Very Low", "#2E8B57"), (2, "Low", "#FFD700"), (3, "Moderate", "#FF8C00"), (4, "High", "#FF4500"),
           (5, "Very High", "#DC143C")]
UNKNOWN = "Unknown"
MASK = (0, 1, 3, 8, 9, 10)
STUDY = {"W": 150.0, "S": -34.0, "E": 150.8, "N": -33.5}
METRES = 111000.0
MARKERS, BATCH, SERIES = 20, 4, 60.0

# --------------------------------------------------------------------------- text helpers


def d(x: float) -> str:
    """A DOUBLE literal (bare ``0.3`` would be DECIMAL)."""
    t = repr(float(x))
    return t if ("e" in t or "inf" in t or "nan" in t) else t + "e0"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(least(({x}), {d(hi)}), {d(lo)}) END)"


def nd(a: str, b: str) -> str:
    return (f"(CASE WHEN ({a} + {b}) <> 0 THEN ({a} - {b}) / ({a} + {b}) "
            f"WHEN ({a} + {b}) = 0 THEN 0e0 END)")


def cindex(a: str, b: str) -> str:
    return clip(nd(a, b), -1.0, 1.0)


def findex(a: str, b: str) -> str:
    eps = d(EPSILON)
    return f"(CASE WHEN ({a} + {b} + {eps}) <> 0 THEN ({a} - {b}) / ({a} + {b} + {eps}) END)"


def health(name: str, x: str) -> str:
    off, span = HEALTH[name]
    return clip(f"({x} + {d(off)}) / {d(span)} * 100e0", 0.0, 100.0)


def component(name: str, x: str) -> str:
    return f"(100e0 - {health(name, x)})"


INDEX_COL = {"NDVI": "ndvi", "NDMI": "ndmi", "NBR": "nbr"}


def calibrated(present=("NDVI", "NDMI", "NBR"), weights=None) -> str:
    given = weights or WEIGHTS
    w = {k: v / sum(given.values()) for k, v in given.items()}
    terms, total = [], 0.0
    for name in ("NDVI", "NDMI", "NBR"):
        if name in present and name in w:
            terms.append(f"{d(w[name])} * {component(name, INDEX_COL[name])}")
            total += w[name]
    if not terms:
        return "0e0"
    acc = terms[0]
    for t in terms[1:]:
        acc = f"({acc} + {t})"
    return clip(f"{acc} / {d(total)}", 0.0, 100.0)


def fast(ndvi="ndvi_fast", ndmi="ndmi_fast", nbr="nbr_fast") -> str:
    w = WEIGHTS
    s = (f"(1e0 - {ndvi}) * 100e0 * {d(w['NDVI'])} + (1e0 - {ndmi}) * 100e0 * {d(w['NDMI'])}"
         f" + (1e0 - {nbr}) * 100e0 * {d(w['NBR'])}")
    return clip(s, 0.0, 100.0)


def simple(ndvi="ndvi", ndmi="ndmi") -> str:
    veg = f"(1e0 - {clip(ndvi, -1.0, 1.0)}) * 50e0"
    moist = f"(1e0 - {clip(ndmi, -1.0, 1.0)}) * 50e0"
    return clip(f"({veg} + {moist}) / 2e0", 0.0, 100.0)


def classify(s: str) -> str:
    t1, t2, t3, t4 = (d(t) for t in THRESHOLDS)
    return (f"(CASE WHEN ({s}) IS NULL THEN 0 WHEN ({s}) < {t1} THEN 1 WHEN ({s}) < {t2} THEN 2 "
            f"WHEN ({s}) < {t3} THEN 3 WHEN ({s}) < {t4} THEN 4 ELSE 5 END)")


def cname(c: str) -> str:
    whens = " ".join(f"WHEN {code} THEN '{name}'" for code, name, _ in CLASSES)
    return f"(CASE ({c}) {whens} ELSE '{UNKNOWN}' END)"


def ccolour(c: str) -> str:
    whens = " ".join(f"WHEN {code} THEN '{col}'" for code, _, col in CLASSES)
    return f"(CASE ({c}) {whens} END)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


MASK_CODES = ", ".join(str(c) for c in MASK)

# --------------------------------------------------------------------------- derived shapes

PIXELS = """pixels AS (
  SELECT l_suppkey % 16 AS tile_id, l_orderkey AS px_row, l_linenumber AS px_col,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS scene_date,
         CASE WHEN l_partkey % 97 = 0 THEN 0e0 ELSE 500e0 + l_quantity * 50e0 END AS b04,
         CASE WHEN l_partkey % 97 = 0 THEN 0e0 ELSE 300e0 + l_extendedprice % 7000e0 END AS b08,
         800e0 + l_discount * 30000e0 AS b11,
         600e0 + l_tax * 30000e0 AS b12,
         CAST(l_partkey % 12 AS INTEGER) AS scl
  FROM lineitem)"""

MASKED = f"""masked AS (
  SELECT tile_id, px_row, px_col, scene_date, scl,
         CASE WHEN coalesce(scl, -1) IN ({MASK_CODES}) THEN NULL ELSE b04 END AS b04,
         CASE WHEN coalesce(scl, -1) IN ({MASK_CODES}) THEN NULL ELSE b08 END AS b08,
         CASE WHEN coalesce(scl, -1) IN ({MASK_CODES}) THEN NULL ELSE b11 END AS b11,
         CASE WHEN coalesce(scl, -1) IN ({MASK_CODES}) THEN NULL ELSE b12 END AS b12
  FROM pixels)"""

GRID = """grid AS (
  SELECT CAST(floor(o_orderkey / 100) AS INTEGER) AS px_row, CAST(o_orderkey % 100 AS INTEGER) AS px_col,
         500e0 + o_totalprice % 2500e0 AS b04,
         300e0 + (o_totalprice * 7e0) % 7000e0 AS b08,
         800e0 + o_custkey % 3000 AS b11,
         600e0 + (o_orderkey * 31) % 2400 AS b12,
         o_custkey AS assessment_id
  FROM orders)"""

ASSESSMENTS = f"""assessments AS (
  SELECT id, assessment_date,
         'POLYGON((' || CAST(xmin AS VARCHAR) || ' ' || CAST(ymin AS VARCHAR) || ', '
                     || CAST(xmax AS VARCHAR) || ' ' || CAST(ymin AS VARCHAR) || ', '
                     || CAST(xmax AS VARCHAR) || ' ' || CAST(ymax AS VARCHAR) || ', '
                     || CAST(xmin AS VARCHAR) || ' ' || CAST(ymax AS VARCHAR) || ', '
                     || CAST(xmin AS VARCHAR) || ' ' || CAST(ymin AS VARCHAR) || '))' AS geom_wkt,
         xmin, ymin, xmax, ymax, risk_score, {cname(classify('risk_score'))} AS risk_category,
         area_hectares
  FROM (
    SELECT c_custkey AS id,
           date '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS assessment_date,
           (150000 + (c_custkey % 80) * 10) / 1000e0 AS xmin,
           (-34000 + (c_custkey % 50) * 10) / 1000e0 AS ymin,
           (150000 + (c_custkey % 80) * 10 + 10 * (1 + c_custkey % 3)) / 1000e0 AS xmax,
           (-34000 + (c_custkey % 50) * 10 + 10 * (1 + c_custkey % 3)) / 1000e0 AS ymax,
           CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE (c_acctbal + 1000e0) / 105e0 END AS risk_score,
           (10 * (1 + c_custkey % 3)) * (10 * (1 + c_custkey % 3)) * 1232.1e0 AS area_hectares
    FROM customer) c)"""

BOUNDARIES = """boundaries AS (
  SELECT CAST(n_nationkey AS BIGINT) AS boundary_id, n_name AS nm,
         (150000 + (n_nationkey % 5) * 160) / 1000e0 AS xmin,
         (-34000 + floor(n_nationkey / 5) * 100) / 1000e0 AS ymin,
         (150000 + (n_nationkey % 5) * 160 + 160) / 1000e0 AS xmax,
         (-34000 + floor(n_nationkey / 5) * 100 + 100) / 1000e0 AS ymax
  FROM nation)"""


POLYGONS = """shapes(kind, shape, part, ring) AS (VALUES
  ('zone', 0, 0, [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]),
  ('zone', 1, 0, [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]), ('zone', 1, 0, [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]),
  ('zone', 2, 0, [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]), ('zone', 2, 1, [[2, 2], [4, 2], [4, 4], [2, 2]]),
  ('zone', 3, 0, [[0, 0], [4, 0], [4, 4], [3, 4], [3, 1], [1, 1], [1, 4], [0, 4], [0, 0]]),
  ('parcel', 0, 0, [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]), ('parcel', 1, 0, [[0, 0], [2, 0], [0, 2], [0, 0]]),
  ('parcel', 2, 0, [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]), ('parcel', 2, 1, [[3, 3], [4, 3], [4, 4], [3, 4], [3, 3]]),
  ('parcel', 3, 0, [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]), ('parcel', 3, 0, [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]])),
geoms AS (
  SELECT 'zone' AS kind, s_suppkey AS id, s_name AS nm, s_suppkey % 4 AS shape, sc,
         150000 + (s_suppkey * 37) % 97 * 10 - back AS x0, -34000 + (s_suppkey * 53) % 61 * 10 - back AS y0
  FROM (SELECT *, (5 + (s_suppkey % 5) * 5) * CASE WHEN s_suppkey % 50 = 7 THEN 200 ELSE 1 END AS sc,
               CASE WHEN s_suppkey % 50 = 7 THEN 2 * (5 + (s_suppkey % 5) * 5) * 200 ELSE 0 END AS back FROM supplier) s
  UNION ALL SELECT 'parcel', c_custkey, NULL, c_custkey % 4, 2 + (c_custkey % 3) * 4, 150000 + (c_custkey % 83) * 12,
         -34000 + (c_custkey % 59) * 11 FROM customer),
edges AS MATERIALIZED (
  SELECT kind, id, part, (x0 + ring[i][1] * sc) / 1000e0 AS px, (y0 + ring[i][2] * sc) / 1000e0 AS py,
         (x0 + ring[i + 1][1] * sc) / 1000e0 AS qx, (y0 + ring[i + 1][2] * sc) / 1000e0 AS qy
  FROM (SELECT g.*, part, ring, unnest(range(1, len(ring))) AS i FROM geoms g JOIN shapes USING (kind, shape)) t),
starts AS MATERIALIZED (SELECT kind, id, part, (x0 + ring[1][1] * sc) / 1000e0 AS x, (y0 + ring[1][2] * sc) / 1000e0 AS y
  FROM geoms JOIN shapes USING (kind, shape)),
bounds AS MATERIALIZED (SELECT kind, id, min(px) AS xmin, min(py) AS ymin, max(px) AS xmax, max(py) AS ymax FROM edges GROUP BY kind, id)"""


def segments_meet(a: str, b: str) -> str:
    """Two edges with ends p and q share a point."""
    def turn(e, f, end):
        return f"sign(({e}.qx - {e}.px) * ({f}.{end}y - {e}.py) - ({e}.qy - {e}.py) * ({f}.{end}x - {e}.px))"

    def on(e, f, end):
        return (f"({turn(e, f, end)} = 0 AND {f}.{end}x BETWEEN least({e}.px, {e}.qx) AND greatest({e}.px, {e}.qx) "
                f"AND {f}.{end}y BETWEEN least({e}.py, {e}.qy) AND greatest({e}.py, {e}.qy))")

    ends = [(a, b, "p"), (a, b, "q"), (b, a, "p"), (b, a, "q")]
    return (f"(({turn(*ends[0])} <> {turn(*ends[1])} AND {turn(*ends[2])} <> {turn(*ends[3])}) OR "
            + " OR ".join(on(*x) for x in ends) + ")")


def ray_crosses(x: str, y: str, e: str) -> str:
    """A ray from (x, y) towards larger x crosses an edge."""
    return (f"((({e}.py > {y}) <> ({e}.qy > {y})) AND {x} < ({e}.qx - {e}.px) * ({y} - {e}.py) / "
            f"(CASE WHEN {e}.qy = {e}.py THEN 1e0 ELSE {e}.qy - {e}.py END) + {e}.px)")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def idx(src: str, name: str) -> str:
    return (f"{name} AS (SELECT *, {cindex('b08', 'b04')} AS ndvi, {cindex('b08', 'b11')} AS ndmi, "
            f"{cindex('b08', 'b12')} AS nbr FROM {src})")


def fidx(src: str, name: str) -> str:
    return (f"{name} AS (SELECT *, {findex('b08', 'b04')} AS ndvi_fast, {findex('b08', 'b11')} AS ndmi_fast, "
            f"{findex('b08', 'b12')} AS nbr_fast FROM {src})")


def scored(src: str, name: str, score: str) -> str:
    return f"{name} AS (SELECT *, {score} AS risk_score FROM {src})"


def classed(src: str, name: str) -> str:
    return f"{name} AS (SELECT *, {classify('risk_score')} AS risk_category FROM {src})"


# Calibrated, cloud-masked pixels with classes: the common base of most reports.
MASKED_SCORED = [PIXELS, MASKED, idx("masked", "mi"), scored("mi", "ms", calibrated()), classed("ms", "mc")]
PIXEL_SCORED = [PIXELS, idx("pixels", "pi"), scored("pi", "ps", calibrated()), classed("ps", "pc")]
GRID_SCORED = [GRID, idx("grid", "gi"), scored("gi", "gs", calibrated()), classed("gs", "gc")]
GRID_FAST = [GRID, fidx("grid", "gf"), scored("gf", "gfs", fast())]
