"""Null-safe numeric building blocks (Column -> Column).

No-data is NULL everywhere: NaN is turned into NULL at ingest because Spark
orders NaN above every number (``NaN >= 80`` is true), which would put a
no-data pixel into the highest class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL; other values (including NULL) unchanged."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c, lo: float, hi: float) -> Column:
    """``clip(x, lo, hi)`` that keeps NULL as NULL.

    ``greatest``/``least`` skip NULL arguments, so a bare
    ``greatest(least(x, hi), lo)`` would turn a NULL into ``lo``.
    """
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def normalized_difference(a, b) -> Column:
    """``(a - b) / (a + b)``, 0 where the sum is exactly 0, NULL if a band is NULL.

    The CASE keeps the division lazy, so ANSI mode never sees ``x / 0``.
    """
    a, b = col(a), col(b)
    den = a + b
    # den = 0 -> 0; den NULL -> the division yields NULL; else the ratio.
    return F.when(den == 0, F.lit(0.0)).otherwise((a - b) / den)


def clipped_index(a, b) -> Column:
    """Calibrated index: normalised difference clipped to [-1, 1].

    Written so the band expressions appear few times: a non-zero, non-NULL
    sum gives a non-NULL ratio, so only the sum needs the NULL check.
    """
    a, b = col(a), col(b)
    den = a + b
    return (F.when(den == 0, F.lit(0.0))
             .when(den.isNotNull(), F.greatest(F.least((a - b) / den, F.lit(1.0)), F.lit(-1.0))))


def epsilon_index(a, b, eps: float = 1e-10) -> Column:
    """Fast index: ``(a - b) / (a + b + eps)`` without clipping.

    The denominator can only be 0 when ``a + b == -eps``; that case is
    guarded so ANSI division never raises.
    """
    a, b = col(a), col(b)
    den = a + b + F.lit(float(eps))
    return F.when(den != 0, (a - b) / den)
