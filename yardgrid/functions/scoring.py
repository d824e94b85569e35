"""Logistic curves and the scalar helpers of the tackle model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intercept and slope of the stored tackle curves.
STORED_CURVES = {
    "base": (-1.1180, 0.2277),
    "cloglog": (-0.64504, 0.09964),
    "new": (-1.2134, 0.2324),
}


def logistic(z: Column) -> Column:
    """Distribution function of the standard logistic."""
    return 1.0 / (1.0 + F.exp(-z))


def tackle_probability(quality: Column | str, model: str = "base") -> Column:
    """Chance of a tackle from the summed quality, by one of the stored curves."""
    quality = F.col(quality) if isinstance(quality, str) else quality
    intercept, slope = STORED_CURVES[model]
    return logistic(F.lit(intercept) + F.lit(slope) * quality)


def log_loss_term(p: Column, y: Column, floor: float = 1e-15) -> Column:
    """Negative log likelihood of one observation with the probability kept off 0 and 1."""
    kept = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return -(y * F.log(kept) + (1 - y) * F.log(1 - kept))


def percent(value: Column, decimals: int = 1) -> Column:
    """Share as a percentage, rounded half to even."""
    return F.bround(value * 100, decimals)
