"""Gate maths of the liquid cell as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column, threshold: float = 20.0) -> Column:
    """log(1 + e^x), linear above ``threshold`` (as the usual implementation)."""
    return F.when(x > threshold, x).otherwise(F.log1p(F.exp(x)))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
