"""Spectral indices over a wide pixel table (one DOUBLE column per band).

All indices are narrow projections: no shuffle, fused into the scan's
whole-stage-codegen stage, and only the bands an index needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..functions.core import clipped_index, epsilon_index

INDEX_COLUMN = {"NDVI": "ndvi", "NDMI": "ndmi", "NBR": "nbr"}


def _require(df: DataFrame, *bands: str) -> None:
    missing = [b for b in bands if b not in df.columns]
    if missing:
        raise ValueError(f"required bands {', '.join(bands)} not loaded (missing {', '.join(missing)})")


def add_index(df: DataFrame, name: str, pos: str | None = None, neg: str | None = None,
              out: str | None = None) -> DataFrame:
    """One calibrated index (0 on a zero sum, clipped to [-1, 1]).

    A direct call with a missing band raises, like the single-index calls.
    """
    dpos, dneg = S.INDEX_BANDS[name]
    pos, neg = pos or dpos, neg or dneg
    _require(df, pos, neg)
    return df.withColumn(out or INDEX_COLUMN[name], clipped_index(pos, neg))


def add_ndvi(df: DataFrame, red: str = "b04", nir: str = "b08", out: str = "ndvi") -> DataFrame:
    return add_index(df, "NDVI", nir, red, out)


def add_ndmi(df: DataFrame, nir: str = "b08", swir1: str = "b11", out: str = "ndmi") -> DataFrame:
    return add_index(df, "NDMI", nir, swir1, out)


def add_nbr(df: DataFrame, nir: str = "b08", swir2: str = "b12", out: str = "nbr") -> DataFrame:
    return add_index(df, "NBR", nir, swir2, out)


def available_indices(df: DataFrame) -> list[str]:
    """Indices whose two bands are columns of ``df`` (decided per data set)."""
    cols = set(df.columns)
    return [name for name, (p, n) in S.INDEX_BANDS.items() if p in cols and n in cols]


def add_all_indices(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Add every index whose bands exist (optionally restricted to ``only``)."""
    names = [n for n in available_indices(df) if only is None or n in only]
    return df.withColumns({INDEX_COLUMN[n]: clipped_index(*S.INDEX_BANDS[n]) for n in names})


def add_fast_indices(df: DataFrame, eps: float = S.FAST_EPSILON, suffix: str = "_fast") -> DataFrame:
    """Fast-path indices: epsilon in the denominator, no clipping, all three required."""
    _require(df, *S.BANDS)
    return df.withColumns({INDEX_COLUMN[n] + suffix: epsilon_index(p, q, eps)
                           for n, (p, q) in S.INDEX_BANDS.items()})
