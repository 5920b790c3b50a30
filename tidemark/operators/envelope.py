"""Elliptic envelope: robust location and scatter, then Mahalanobis distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import chi2_quantile
from tidemark.functions.types import as_double
from tidemark.operators.sampling import bounded_sample
from tidemark.plans.quantiles import SMALL_VALUES, scalar_quantiles
from tidemark.plans.storage import freeze

START_ROWS = 1500
STARTS = 30
MAX_STEPS = 30
# Accuracy of the distance quantile that steers the concentration steps.
STEP_ACCURACY = 10_000
# Steps end when the determinant falls by less than this share.
STEP_GAIN = 1e-6


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    gap = x - mean
    return np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(cov), gap)


def concentrate(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Smallest-determinant half of a small sample over several random starts."""
    n, d = x.shape
    keep = math.ceil(0.5 * (n + d + 1))
    best, best_det = None, math.inf
    for _ in range(STARTS):
        chosen = x[rng.choice(n, size=min(n, d + 1), replace=False)]
        mean, cov, last = chosen.mean(axis=0), np.cov(chosen.T, bias=True).reshape(d, d), math.inf
        for _ in range(MAX_STEPS):
            nearest = x[np.argsort(_distances(x, mean, cov), kind="stable")[:keep]]
            mean, cov = nearest.mean(axis=0), np.cov(nearest.T, bias=True).reshape(d, d)
            det = float(np.linalg.det(cov))
            if det >= last or det <= 0.0:
                break
            last = det
        det = float(np.linalg.det(cov))
        if det < best_det:
            best, best_det = (mean, cov), det
    return best


def mahalanobis(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a plain column expression."""
    inverse = np.linalg.pinv(cov)
    gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean)]
    total = F.lit(0.0)
    for i, a in enumerate(gaps):
        total = total + F.lit(float(inverse[i, i])) * a * a
        for j in range(i + 1, len(gaps)):
            total = total + F.lit(2.0 * float(inverse[i, j])) * a * gaps[j]
    return F.greatest(total, F.lit(0.0))


def _moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and population covariance: one aggregation, d² numbers to the driver."""
    d = len(columns)
    exprs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    exprs += [
        F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)
    ]
    row = df.agg(*exprs).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], dtype=float)
    return np.array([row[f"m{i}"] for i in range(d)], dtype=float), cov


def fit_envelope(
    points: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    seed: int = 42,
    small_values: int = SMALL_VALUES,
    unique: bool = True,
) -> tuple[np.ndarray, np.ndarray]:
    """Reweighted minimum-covariance-determinant estimate over all rows of ``points``.

    A bounded sample gives the starting ellipse; concentration steps then run on
    the whole table as aggregations.
    """
    d, total = len(columns), points.count()
    if total < d + 1:
        raise ValueError("too few complete rows for an envelope")
    start = bounded_sample(points, keys, START_ROWS, total, seed, unique).select(*columns).toPandas().to_numpy(dtype=float)
    mean, cov = concentrate(start, np.random.default_rng(seed))
    half = math.ceil(0.5 * (total + d + 1)) / total
    last = math.inf
    for _ in range(MAX_STEPS):
        distance = mahalanobis(columns, mean, cov)
        cut = points.agg(F.percentile_approx(distance, half, STEP_ACCURACY).alias("q")).first()["q"]
        new_mean, new_cov = _moments(points.where(distance <= F.lit(cut)), columns)
        det = float(np.linalg.det(new_cov))
        if not det < last * (1 - STEP_GAIN):
            break
        mean, cov, last = new_mean, new_cov, det
    measured = points.withColumn("__d", mahalanobis(columns, mean, cov))
    median = scalar_quantiles(measured, "__d", {"m": 0.5}, small_values)["m"]
    scale = median / chi2_quantile(0.5, d)
    inside = measured.where(F.col("__d") / F.lit(scale) < F.lit(chi2_quantile(0.975, d)))
    return _moments(inside, columns)


def elliptic_envelope(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    contamination: float = 0.1,
    seed: int = 42,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Every row with ``score`` (minus the squared distance, null if incomplete) and ``is_anomaly``."""
    columns = [f"__x{i}" for i in range(len(features))]
    stats = df.agg(
        *[F.avg(as_double(df, f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(as_double(df, f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    scaled = df.withColumns(
        {
            c: (as_double(df, f) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
            for i, (c, f) in enumerate(zip(columns, features))
        }
    )
    complete = freeze(scaled.select(*dict.fromkeys([*keys, *columns])).dropna(subset=columns))
    mean, cov = fit_envelope(complete, columns, keys, seed, small_values, set(keys) != set(df.columns))
    cut = scalar_quantiles(
        complete.withColumn("__s", -mahalanobis(columns, mean, cov)), "__s", {"cut": contamination}, small_values
    )["cut"]
    return (
        scaled.withColumn("score", -mahalanobis(columns, mean, cov))
        .withColumn("is_anomaly", F.coalesce(F.col("score") < F.lit(cut), F.lit(False)))
        .drop(*columns)
    )
