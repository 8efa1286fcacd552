"""Score models and classification as column expressions.

Three models exist and give different numbers for the same pixel:

* calibrated -- per-index health rescaling, weighted mean of the components of
  the indices that are present, renormalised by the weight actually used;
* fast -- ``(1 - index) * 100 * w`` summed over NDVI/NDMI/NBR, clipped;
* simple -- ``(1 - clip(ndvi)) * 50``, averaged with the NDMI term if given.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .core import clip, col

INDEX_ORDER = ("NDVI", "NDMI", "NBR")
INDEX_COLUMNS = {"NDVI": "ndvi", "NDMI": "ndmi", "NBR": "nbr"}


# --------------------------------------------------------------------------- weights

def normalize_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Custom weights divided by their sum; ``None``/empty means the defaults."""
    w = dict(weights) if weights else dict(S.DEFAULT_WEIGHTS)
    total = sum(w.values())
    if total == 0:
        raise ValueError("index weights sum to zero")
    return {k: v / total for k, v in w.items()}


# --------------------------------------------------------------------------- components

def health_score(index_name: str, x) -> Column:
    """0-100 health of one index: ``clip((x + offset) / span * 100, 0, 100)``."""
    offset, span = S.HEALTH_SCALE[index_name]
    return clip((col(x) + F.lit(offset)) / F.lit(span) * F.lit(100.0), 0.0, 100.0)


def vegetation_health(ndvi) -> Column:
    return health_score("NDVI", ndvi)


def moisture_score(ndmi) -> Column:
    return health_score("NDMI", ndmi)


def burn_resistance(nbr) -> Column:
    """Named 'susceptibility' upstream, but higher means safer."""
    return health_score("NBR", nbr)


def risk_component(index_name: str, x) -> Column:
    return F.lit(100.0) - health_score(index_name, x)


# --------------------------------------------------------------------------- models

def calibrated_score(present: Iterable[str], weights: Mapping[str, float] | None = None,
                     columns: Mapping[str, str] | None = None) -> Column:
    """Calibrated 0-100 risk over the indices ``present`` in the data set.

    ``sum(w_i * component_i) / sum(w_i)`` over the present indices that carry a
    weight, then clipped. With no weighted index present the score is 0.
    """
    columns = dict(INDEX_COLUMNS, **(columns or {}))
    present = [p for p in INDEX_ORDER if p in set(present)]
    if not present:
        raise ValueError("no index (NDVI, NDMI, NBR) available for risk scoring")
    w = normalize_weights(weights)
    acc = None
    total = 0.0
    for name in present:
        if name not in w:
            continue
        term = F.lit(w[name]) * risk_component(name, columns[name])
        acc = term if acc is None else acc + term
        total += w[name]
    if acc is None:
        # No present index carries a weight: the weighted sum stays all-zero,
        # for no-data pixels too.
        return F.lit(0.0)
    if total > 0:
        acc = acc / F.lit(total)
    return clip(acc, 0.0, 100.0)


def fast_score(ndvi="ndvi_fast", ndmi="ndmi_fast", nbr="nbr_fast",
               weights: Mapping[str, float] | None = None) -> Column:
    """Fast model: ``sum((1 - index) * 100 * w)`` clipped to 0-100."""
    w = dict(S.FAST_WEIGHTS, **(weights or {}))
    total = ((F.lit(1.0) - col(ndvi)) * F.lit(100.0) * F.lit(w["NDVI"])
             + (F.lit(1.0) - col(ndmi)) * F.lit(100.0) * F.lit(w["NDMI"])
             + (F.lit(1.0) - col(nbr)) * F.lit(100.0) * F.lit(w["NBR"]))
    return clip(total, 0.0, 100.0)


def simple_score(ndvi="ndvi", ndmi=None) -> Column:
    """Simple model; the NDMI term is optional."""
    veg = (F.lit(1.0) - clip(ndvi, -1.0, 1.0)) * F.lit(50.0)
    if ndmi is None:
        score = veg
    else:
        moist = (F.lit(1.0) - clip(ndmi, -1.0, 1.0)) * F.lit(50.0)
        score = (veg + moist) / F.lit(2.0)
    return clip(score, 0.0, 100.0)


# --------------------------------------------------------------------------- classes

def classify(score) -> Column:
    """Score -> class code 1..5, 0 for no data (NULL).

    Closed on the left: 20 is Low, 60 is High. Scores below 0 stay class 1 and
    above 100 class 5. (``width_bucket`` would give 6 at the top edge and
    NULL for NULL, hence the explicit CASE.)
    """
    s = col(score)
    t1, t2, t3, t4 = (F.lit(t) for t in S.CLASS_THRESHOLDS)
    return (F.when(s.isNull(), F.lit(0))
            .when(s < t1, F.lit(1))
            .when(s < t2, F.lit(2))
            .when(s < t3, F.lit(3))
            .when(s < t4, F.lit(4))
            .otherwise(F.lit(5)))


def class_at_least(score, k: int) -> Column:
    """Row predicate equivalent to ``classify(score) >= k`` (k in 1..5).

    Filters on the class code get pushed below the projections and inline the
    whole score expression once per CASE branch; the threshold form keeps the
    pushed predicate to a single copy of the score.
    """
    s = col(score)
    if k <= 0:
        return F.lit(True)
    if k == 1:
        return s.isNotNull()
    return s >= F.lit(S.CLASS_THRESHOLDS[k - 2])


def where_computed(df, cond: Column):
    """``df.where(cond)`` for a condition on *derived* columns (the score).

    Catalyst pushes a filter below projections by substituting the projected
    expressions; for a deep expression like the risk score this copies the
    whole score into the scan-side filter (and again per reference), which
    produces a generated method too large for the JIT -- the stage then runs
    interpreted, ~10x slower. A filter on a generator's output is not pushed
    below the generator, so the projection computes the score once and the
    filter only reads it. (Rows are neither added nor dropped by the
    one-element explode.)
    """
    return (df.select("*", F.explode(F.array(cond)).alias("_keep"))
              .where(F.col("_keep")).drop("_keep"))


def category_name(code) -> Column:
    """Class code -> name, ``Unknown`` for anything outside 1..5.

    A five-way CASE is cheaper than a join and stays inside codegen; the
    dimension table form is ``schema.category_dim`` for feeds.
    """
    c = col(code)
    expr = F.when(c == F.lit(S.CATEGORY_ROWS[0][0]), F.lit(S.CATEGORY_ROWS[0][1]))
    for code_, name, _, _ in S.CATEGORY_ROWS[1:]:
        expr = expr.when(c == F.lit(code_), F.lit(name))
    return expr.otherwise(F.lit(S.UNKNOWN_NAME))


def score_label(score) -> Column:
    """Label of a (mean) score; NULL mean -> ``Unknown``."""
    return category_name(classify(score))


def category_colour(code) -> Column:
    c = col(code)
    expr = F.when(c == F.lit(S.CATEGORY_ROWS[0][0]), F.lit(S.CATEGORY_ROWS[0][3]))
    for code_, _, _, colour in S.CATEGORY_ROWS[1:]:
        expr = expr.when(c == F.lit(code_), F.lit(colour))
    return expr
