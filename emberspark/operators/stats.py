"""Aggregates: class distribution, area statistics, summaries, series, reports.

Every aggregate is a hash aggregate with a map-side partial step, so a hot
key (one class or one date holding a third of all pixels) is pre-combined in
each task before the shuffle; only one row per key and task crosses it.
Shares use totals computed by a window over the *aggregated* rows (at most one
row per class), never a second scan or a join against the pixel table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scores import category_name, score_label

ROUND = 6


def r6(c) -> Column:
    """Floating sums depend on evaluation order; round reported means/sums."""
    return F.round(c if isinstance(c, Column) else F.col(c), ROUND)


CLASS_CODES = tuple(range(0, len(S.CATEGORY_ROWS) + 1))   # 0 = no data, 1..5


def _class_counts(df: DataFrame, cat: str, by: list[str], codes) -> DataFrame:
    """One row per ``by`` group with a count per class code, in one hash
    aggregate (partial counts per task, then one row per group crosses the
    shuffle), unpivoted to ``(by..., cat, pixels, _all, _valid)`` rows.

    The class set is fixed, so conditional counts replace a group-by on the
    derived class: no filter on the class is ever pushed into the scan, no
    window is needed for the totals (they sit in the same row), and classes
    that do not occur are dropped after aggregation.
    """
    c = F.col(cat)
    agg = df.groupBy(*by).agg(
        *[F.count_if(c == F.lit(k)).alias(f"_n{k}") for k in codes],
        F.count(F.lit(1)).alias("_all"),
        F.count_if(c > 0).alias("_valid"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias(cat), F.col(f"_n{k}").alias("pixels")) for k in codes]))
    return (agg.select(*by, rows.alias("_e"), "_all", "_valid")
               .select(*by, "_e.*", "_all", "_valid")
               .where(F.col("pixels") > 0))


def class_distribution(df: DataFrame, cat: str = "risk_category", by: list[str] | None = None) -> DataFrame:
    """Pixels per class (including 0 = no data) and % of *all* pixels."""
    by = by or []
    g = _class_counts(df, cat, by, CLASS_CODES)
    return g.select(*by, cat, "pixels",
                    r6(F.col("pixels") / F.col("_all") * F.lit(100.0)).alias("pct_all"),
                    category_name(cat).alias("category_name"))


def area_statistics(df: DataFrame, cat: str = "risk_category", pixel_area_m2: float = S.PIXEL_AREA_M2,
                    by: list[str] | None = None) -> DataFrame:
    """Per occurring class > 0: pixels, m², hectares and % of *valid* pixels."""
    by = by or []
    g = _class_counts(df, cat, by, CLASS_CODES[1:])
    area_m2 = F.col("pixels") * F.lit(float(pixel_area_m2))
    return g.select(
        *by, cat, category_name(cat).alias("category_name"), "pixels",
        area_m2.alias("area_m2"),
        (area_m2 / F.lit(10000.0)).alias("area_hectares"),
        r6(F.col("pixels") / F.col("_valid") * F.lit(100.0)).alias("pct_valid"),
    )


def min_max_mean(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One pass: ``<c>_min, <c>_max, <c>_mean`` for each column (NULL-skipping)."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), r6(F.avg(c)).alias(f"{c}_mean")]
    return df.groupBy(*(by or [])).agg(*aggs)


def mask_count(df: DataFrame, flag: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.count_if(flag).alias("masked_pixels"), F.count(F.lit(1)).alias("total_pixels"))


def run_summary(df: DataFrame, score: str = "risk_score", cat: str = "risk_category") -> DataFrame:
    """Mean score over valid pixels, % of *all* pixels in class >= 4, pixel count."""
    return df.agg(
        r6(F.avg(score)).alias("mean_risk_score"),
        r6(F.count_if(F.col(cat) >= 4) / F.count(F.lit(1)) * F.lit(100.0)).alias("high_risk_percentage"),
        F.count(F.lit(1)).alias("total_pixels"),
    )


def scene_means(df: DataFrame, by: list[str], score: str = "risk_score") -> DataFrame:
    """NaN-skipping means persisted per scene plus the label of the mean score."""
    idx = [c for c in ("ndvi", "ndmi", "nbr") if c in df.columns]
    g = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in idx],
        F.avg(score).alias("mean_risk_score"),
        F.count(F.lit(1)).alias("pixels"))
    return g.select(*by, *[r6(f"{c}_mean").alias(f"{c}_mean") for c in idx],
                    r6("mean_risk_score").alias("mean_risk_score"),
                    score_label("mean_risk_score").alias("risk_category"), "pixels")


def time_series(df: DataFrame, date: str = "scene_date", score: str = "risk_score",
                threshold: float = S.SERIES_HIGH_RISK) -> DataFrame:
    """Per date: mean, max and % of pixels with score strictly above ``threshold``
    (over all pixels of the date)."""
    return df.groupBy(date).agg(
        r6(F.avg(score)).alias("mean_risk"),
        F.max(score).alias("max_risk"),
        r6(F.count_if(F.col(score) > F.lit(threshold)) / F.count(F.lit(1)) * F.lit(100.0)).alias("high_risk_area"),
    )


def series_arrays(series: DataFrame, date: str = "scene_date",
                  fields=("mean_risk", "max_risk", "high_risk_area")) -> DataFrame:
    """Struct-of-arrays export of an *aggregated* series (one row per date), in
    date order. Input size is the number of dates, not pixels."""
    packed = series.agg(F.sort_array(F.collect_list(F.struct(date, *fields))).alias("s"))
    def field(name):
        return F.transform("s", lambda e: e[name])

    return packed.select(field(date).alias("dates"), *[field(f).alias(f + "s") for f in fields])


def tile_means(df: DataFrame, tile: str = "tile_id", score: str = "risk_score", digits: int = 2) -> DataFrame:
    """Mean score per tile, rounded as the per-tile report line prints it."""
    return df.groupBy(tile).agg(F.round(F.avg(score), digits).alias("tile_mean_risk"))


def batch_report(tile_stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tile count and avg/min/max of the (rounded) tile means, unweighted."""
    return tile_stats.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("tiles"),
        r6(F.avg("tile_mean_risk")).alias("avg_risk"),
        F.min("tile_mean_risk").alias("min_risk"),
        F.max("tile_mean_risk").alias("max_risk"),
    )


def assessment_statistics(df: DataFrame) -> DataFrame:
    """Whole-table statistics; an empty table gives one row of 0 counts and NULLs."""
    cat = F.col("risk_category")

    def n(name):
        return F.count(F.when(cat == F.lit(name), F.lit(1)))

    return df.agg(
        F.count(F.lit(1)).alias("total_assessments"),
        r6(F.avg("risk_score")).alias("avg_risk_score"),
        F.min("risk_score").alias("min_risk_score"),
        F.max("risk_score").alias("max_risk_score"),
        r6(F.sum("area_hectares")).alias("total_area_hectares"),
        n("Very High").alias("very_high_count"),
        n("High").alias("high_count"),
        n("Moderate").alias("moderate_count"),
        n("Low").alias("low_count"),
        n("Very Low").alias("very_low_count"),
    )


def class_chart_feed(stats: DataFrame) -> DataFrame:
    """Unpivot the five class counts of ``assessment_statistics``, keep the
    non-zero ones and attach their share of the charted total."""
    names = [(code, name, name.lower().replace(" ", "_") + "_count") for code, name, _, _ in S.CATEGORY_ROWS]
    long = stats.select(F.explode(F.array(*[
        F.struct(F.lit(code).alias("risk_category"), F.lit(name).alias("category_name"),
                 F.col(c).alias("n")) for code, name, c in names])).alias("e"),
        F.col("avg_risk_score").alias("mean_marker")).select("e.*", "mean_marker")
    nz = long.where(F.col("n") > 0)
    total = F.sum("n").over(Window.partitionBy())
    return nz.withColumn("share_pct", r6(F.col("n") / total * F.lit(100.0)))
