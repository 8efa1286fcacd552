"""Column -> Column building blocks (pure expressions, JVM-side, codegen-friendly)."""

from .core import clip, clipped_index, epsilon_index, nan_to_null, normalized_difference
from .scores import (
    burn_resistance, calibrated_score, category_name, classify, fast_score, health_score,
    moisture_score, normalize_weights, risk_component, score_label, simple_score, vegetation_health,
)

__all__ = [
    "clip", "clipped_index", "epsilon_index", "nan_to_null", "normalized_difference",
    "burn_resistance", "calibrated_score", "category_name", "classify", "fast_score", "health_score",
    "moisture_score", "normalize_weights", "risk_component", "score_label", "simple_score",
    "vegetation_health",
]
