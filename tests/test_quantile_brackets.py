"""Quantiles whose values are narrowed down by a sketch first, against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import quantiles as q

POINTS = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.2505, "e": 0.5, "f": 0.75, "g": 0.99, "h": 1.0}


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    n = 60_000
    return pd.DataFrame(
        {
            "spread": rng.normal(0, 1e6, n),
            "sorted": np.arange(n, dtype=float),
            "few": rng.integers(0, 4, n).astype(float),
            "hot": np.where(rng.random(n) < 0.6, 7.0, rng.exponential(7, n)),
            "gap": np.where(np.arange(n) % 2 == 0, -5.0 - rng.random(n), 5.0 + rng.random(n)),
        }
    )


@pytest.mark.parametrize("small_values", [0, q.SMALL_VALUES])
def test_equal_to_numpy(spark, numbers, small_values):
    df = spark.createDataFrame(numbers).repartition(13)
    got = {r["column"]: r for r in q.quantiles(df, list(numbers), POINTS, small_values=small_values).collect()}
    for c in numbers:
        for name, p in POINTS.items():
            assert got[c][name] == pytest.approx(np.quantile(numbers[c], p), rel=1e-12, abs=1e-12), (c, p)


def test_few_values_are_left_to_count(spark, numbers):
    df = spark.createDataFrame(numbers).repartition(13)
    distinct = q.value_counts(q.narrowed(df, ["spread", "sorted"], [0.25, 0.5]), ["column"]).groupBy("column").count()
    # two brackets of 2 * BRACKET_SHARE, and the sketch's own error at each of four ends
    bound = len(numbers) * (4 * q.BRACKET_SHARE + 4 / q.SKETCH_ACCURACY) + 4
    assert all(r["count"] <= bound for r in distinct.collect())


def test_nulls_nan_infinity_short_and_empty_columns(spark):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("half"),
        F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("nan"),
        F.when(F.col("id") < 9, F.col("id").cast("double")).alias("nine"),
        F.when(F.col("id") % 3 == 0, F.lit(float("inf"))).otherwise(-F.col("id").cast("double")).alias("inf"),
        F.lit(None).cast("double").alias("none"),
        F.col("id").cast("decimal(20,2)").alias("a.b"),
    )
    got = {r["column"]: r["m"] for r in q.quantiles(df, df.columns, {"m": 0.5}).collect()}
    ids = np.arange(n, dtype=float)
    assert got["half"] == np.median(ids[::2])
    assert got["nan"] == np.median(ids[ids % 4 != 0])
    assert got["nine"] == 4.0
    assert got["inf"] == np.median(np.where(ids % 3 == 0, np.inf, -ids))
    assert got["a.b"] == np.median(ids)
    assert "none" not in got
    assert q.quantiles(df.limit(0), ["half"], {"m": 0.5}).count() == 0
