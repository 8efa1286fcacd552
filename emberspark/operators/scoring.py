"""Attach scores and classes to a pixel DataFrame (narrow projections)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..functions import scores as SC
from .indices import INDEX_COLUMN, add_all_indices, add_fast_indices


def present_indices(df: DataFrame) -> list[str]:
    return [n for n, c in INDEX_COLUMN.items() if c in df.columns]


def add_components(df: DataFrame) -> DataFrame:
    """0-100 health, moisture and burn-resistance scores of the present indices."""
    out = {}
    if "ndvi" in df.columns:
        out["vegetation_health"] = SC.vegetation_health("ndvi")
    if "ndmi" in df.columns:
        out["moisture_score"] = SC.moisture_score("ndmi")
    if "nbr" in df.columns:
        out["burn_resistance"] = SC.burn_resistance("nbr")
    return df.withColumns(out)


def add_calibrated_score(df: DataFrame, weights: Mapping[str, float] | None = None,
                         out: str = "risk_score") -> DataFrame:
    """Calibrated score over the indices present in ``df`` (renormalised)."""
    return df.withColumn(out, SC.calibrated_score(present_indices(df), weights))


def add_fast_score(df: DataFrame, out: str = "risk_score") -> DataFrame:
    return df.withColumn(out, SC.fast_score())


def add_simple_score(df: DataFrame, use_ndmi: bool = True, out: str = "risk_score") -> DataFrame:
    ndmi = "ndmi" if use_ndmi and "ndmi" in df.columns else None
    return df.withColumn(out, SC.simple_score("ndvi", ndmi))


def add_class(df: DataFrame, score: str = "risk_score", out: str = "risk_category",
              name: str | None = "category_name") -> DataFrame:
    df = df.withColumn(out, SC.classify(score))
    if name:
        df = df.withColumn(name, SC.category_name(out))
    return df


def score_pixels(df: DataFrame, model: str = "calibrated", weights=None,
                 with_class: bool = True) -> DataFrame:
    """Bands -> indices -> score (-> class) in one projection."""
    if model == "calibrated":
        df = add_calibrated_score(add_all_indices(df), weights)
    elif model == "fast":
        df = add_fast_score(add_fast_indices(df))
    elif model == "simple":
        df = add_simple_score(add_all_indices(df, only=["NDVI", "NDMI"]))
    else:
        raise ValueError(f"unknown score model {model!r}")
    return add_class(df, name=None) if with_class else df


def add_calibrated_score_by(df: DataFrame, weights: DataFrame, key: str, out: str = "risk_score") -> DataFrame:
    """Calibrated score with weights that come from a table (per-region models).

    ``weights`` has one row per ``key`` value with any of the columns
    ``w_ndvi, w_ndmi, w_nbr`` (missing/NULL = weight 0 after normalisation;
    a region without a row keeps the default weights). The weight table is
    joined by key -- one row per region, so AQE broadcasts it by its runtime
    size -- and the weights are normalised per row by their sum; the sum is
    then restricted to the indices present in ``df``, as in the fixed-weight
    model.
    """
    from pyspark.sql import functions as F

    from .. import schema as S
    from ..functions.core import clip
    present = present_indices(df)
    if not present:
        raise ValueError("no index (NDVI, NDMI, NBR) available for risk scoring")
    wcols = {"NDVI": "w_ndvi", "NDMI": "w_ndmi", "NBR": "w_nbr"}
    wt = weights.select(key, *[F.col(c) for c in wcols.values() if c in weights.columns])
    j = df.join(wt, key, "left")
    has_row = F.coalesce(*[F.col(c).isNotNull() for c in wcols.values() if c in wt.columns], F.lit(False))
    w = {}
    for name, c in wcols.items():
        given = F.coalesce(F.col(c), F.lit(0.0)) if c in wt.columns else F.lit(0.0)
        w[name] = F.when(has_row, given).otherwise(F.lit(S.DEFAULT_WEIGHTS[name]))
    total = w["NDVI"] + w["NDMI"] + w["NBR"]
    norm = {n: F.when(total != 0, w[n] / total) for n in w}
    acc, used = None, None
    for name in SC.INDEX_ORDER:
        if name not in present:
            continue
        term = norm[name] * SC.risk_component(name, SC.INDEX_COLUMNS[name])
        acc = term if acc is None else acc + term
        used = norm[name] if used is None else used + norm[name]
    score = F.when(used > 0, clip(acc / used, 0.0, 100.0)).otherwise(F.lit(0.0))
    drop = [c for c in wcols.values() if c in wt.columns]
    return j.withColumn(out, score).drop(*drop)
