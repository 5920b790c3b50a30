"""Aggregate expressions whose conventions differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness G1 (null below three values or without spread)."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    usable = (n > 2) & ~F.isnan(g1)
    return F.when(usable, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (null below four values or without spread)."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n > 3) & ~F.isnan(g2), scale * ((n + 1) * g2 + 6))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as double, null when the whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return share(part, whole) * 100
