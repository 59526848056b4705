"""Moments and quantiles with the sample corrections that users of data frames expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(c: Column, p: float, approx: bool = False) -> Column:
    """Linear interpolation, exact; ``approx`` bounds memory on very many distinct values."""
    return F.percentile_approx(c, F.lit(p), F.lit(10_000)).cast("double") if approx else F.percentile(c, F.lit(p))


def skewness(c: Column) -> Column:
    """Adjusted (G1); null under three values, zero for a constant."""
    n, g = F.count(c), F.skewness(c)
    return F.when(n < 3, None).when(F.coalesce(F.var_pop(c), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)) * g)


def kurtosis(c: Column) -> Column:
    """Adjusted excess (G2); null under four values, zero for a constant."""
    n, g = F.count(c), F.kurtosis(c)
    scale = F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))
    return F.when(n < 4, None).when(F.coalesce(F.var_pop(c), F.lit(0.0)) == 0, F.lit(0.0)).otherwise((n - 1.0) / scale * ((n + 1.0) * g + 6))


def mode(c: Column) -> Column:
    """The most frequent value; the smallest of ties."""
    return F.mode(c, True)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(100 * ratio(a, b), digits)
