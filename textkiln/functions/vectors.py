"""Vector-column maths with higher-order functions (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkiln.constants import RMS_EPS


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length numeric arrays."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rms_norm(a: Column, weight: Column | None = None, eps: float = RMS_EPS) -> Column:
    """``x / sqrt(mean(x^2) + eps) * weight``; weight defaults to ones."""
    inv = F.lit(1.0) / F.sqrt(dot(a, a) / F.size(a) + F.lit(eps))
    scaled = F.transform(a, lambda x: x.cast("double") * inv)
    if weight is None:
        return scaled
    return F.zip_with(scaled, weight, lambda x, w: x * w.cast("double"))
