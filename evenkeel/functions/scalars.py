"""Scalar expressions that several plans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the age bins.
AGE_BOUNDS = (1, 18, 25, 35, 45, 50, 56)


def score_bin(score: Column, low: float, high: float, step: float) -> Column:
    """Place of the level of a score domain that is nearest, halves upwards."""
    top = int(round((high - low) / step))
    return F.least(F.greatest(F.floor((score - low) / step + 0.5), F.lit(0)), F.lit(top)).cast("int")


def binarize(score: Column, threshold: float) -> Column:
    return F.when(score <= threshold, 0).otherwise(1)


def age_bin(age: Column) -> Column:
    """The largest bound up to the age; null for ages of 0 and below and where there is none."""
    out = F.lit(None).cast("int")
    for bound in AGE_BOUNDS:
        out = F.when(age >= bound, F.lit(bound)).otherwise(out)
    return F.when(age > 0, out)


def power_transform(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform of a fixed parameter."""
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def safe_sigmoid(x: Column, edge: float = 34.538776394910684) -> Column:
    """Logistic function of the argument clipped to +-``edge``, where 1 - 1e-15 is reached."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(edge)), F.lit(-edge))))


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percentage_difference(a: Column, b: Column) -> Column:
    """|a - b| over their mean; 0 if that isn't positive."""
    return F.when(a + b > 0, F.abs(a - b) / ((a + b) / 2)).otherwise(0.0)


def six_places(x: Column) -> Column:
    """``x`` to 6 places, halves away from zero: as ``round`` but for ties of the binary value, and without decimal numbers, for expressions over very many rows."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6
