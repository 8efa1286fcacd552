"""Ingest rules, the cloud mask and the assessment-table quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.core import nan_to_null


def ingest_bands(df: DataFrame, bands=S.BANDS, nodata: float | None = None) -> DataFrame:
    """NaN -> NULL for every band present; optionally a nodata value -> NULL too.

    (The scene's nodata value is captured with the metadata; applying it is
    opt-in so a legitimate 0 reflectance is not lost by default.)
    """
    present = [b for b in bands if b in df.columns]
    out = {}
    for b in present:
        c = nan_to_null(b)
        if nodata is not None:
            c = F.when(c != F.lit(float(nodata)), c)
        out[b] = c
    return df.withColumns(out) if out else df


def cloud_flag(scl: str = "scl", codes=S.MASKED_SCL_CODES) -> Column:
    """True for masked pixels; NULL SCL keeps the pixel."""
    return F.coalesce(F.col(scl), F.lit(-1)).isin(list(codes))


def apply_cloud_mask(df: DataFrame, scl: str = "scl", bands=S.BANDS,
                     codes=S.MASKED_SCL_CODES) -> DataFrame:
    """Masked pixels get NULL bands (so NULL indices/scores and class 0).

    Not a row filter: counts over all pixels must still see masked pixels.
    Without an SCL column the data is returned unchanged.
    """
    if scl not in df.columns:
        return df
    masked = cloud_flag(scl, codes)
    return df.withColumns({b: F.when(~masked, F.col(b)) for b in bands if b in df.columns})


def assessment_check(score: str = "risk_score") -> Column:
    """Reason a record breaks the table constraints, NULL when it is valid.

    Score must be within 0..100 (NULL passes, NaN fails); date and geometry
    must be present.
    """
    s = F.col(score)
    return (F.when(F.col("assessment_date").isNull(), F.lit("assessment_date is null"))
            .when(F.col("geom_wkt").isNull(), F.lit("geometry is null"))
            .when(s.isNotNull() & F.isnan(s), F.lit("risk_score is NaN"))
            .when(s.isNotNull() & ((s < 0) | (s > 100)), F.lit("risk_score outside 0..100")))


def split_valid(df: DataFrame, score: str = "risk_score") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) halves of an assessment DataFrame; one pass each,
    both lazily derived from the same input (cache upstream if re-read)."""
    checked = df.withColumn("_reason", assessment_check(score))
    valid = checked.where(F.col("_reason").isNull()).drop("_reason")
    quarantine = checked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return valid, quarantine


def enforce_valid(df: DataFrame, score: str = "risk_score") -> DataFrame:
    """Strict mode: fail the job on the first invalid record."""
    reason = assessment_check(score)
    # A predicate, not a helper column: an unused column would be pruned away
    # together with its raise_error.
    return df.where(F.when(reason.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("constraint violated: "), reason)).cast("boolean")))
