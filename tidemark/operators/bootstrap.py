"""Bootstrap intervals of medians.

The median of a resample is an order statistic of the sample, and the rank it
falls on has a known distribution.  So a replicate draws two ranks instead of
n rows; only the values at those ranks are then looked up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hypothesis import grouped_values
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.quantiles import running_counts, value_counts
from tidemark.plans.shipping import ship_package

DRAWS = 1000
MIN_VALUES = 10
_KEYS = ["column", "grp"]


def median_ranks(n: int, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """0-based ranks of the two middle values of ``draws`` resamples of size ``n``."""
    half = n // 2
    if n % 2:
        spot = rng.beta(half + 1, half + 1, draws)
        low = high = spot
    else:
        low = rng.beta(half, half + 1, draws)
        high = low + (1.0 - low) * -np.expm1(np.log(rng.random(draws)) / half)
    last = n - 1
    return tuple(np.clip(np.floor(n * u).astype("int64"), 0, last) for u in (low, high))


def _values_at_ranks(counted: DataFrame, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value): the value covering each wanted rank.

    Both sides are cut into rank buckets over the wanted span, so the match is an
    equi-join on buckets of bounded size.
    """
    span = ranks.groupBy(*_KEYS).agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    span = span.withColumn("step", F.floor((F.col("high") - F.col("low")) / 1000) + 1)
    start, end = F.greatest("before", "low"), F.least(F.col("before") + F.col("c") - 1, F.col("high"))
    covering = (
        attach(counted, span, _KEYS)
        .where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("c") > F.col("low")))
        .withColumn(
            "bucket",
            F.explode(
                F.sequence(F.floor((start - F.col("low")) / F.col("step")), F.floor((end - F.col("low")) / F.col("step")))
            ),
        )
        .select(*_KEYS, "bucket", "before", "c", "value")
    )
    wanted = attach(ranks, span, _KEYS).select(
        *_KEYS, "rank", F.floor((F.col("rank") - F.col("low")) / F.col("step")).alias("bucket")
    )
    return (
        null_safe_join(wanted, covering, [*_KEYS, "bucket"])
        .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        .select(*_KEYS, "rank", "value")
    )


def median_draws(long: DataFrame, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(column, grp, draw, median) for groups of at least ten values."""
    ship_package(long.sparkSession)
    counted = running_counts(value_counts(long, _KEYS), _KEYS)
    sizes = counted.groupBy(*_KEYS).agg(F.first("total").alias("n")).where(F.col("n") >= MIN_VALUES)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for column, grp, n in batch[["column", "grp", "n"]].itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(f"{column}|{grp}".encode())])
                low, high = median_ranks(int(n), draws, rng)
                yield pd.DataFrame(
                    {"column": column, "grp": grp, "draw": np.arange(draws), "low": low, "high": high}
                )

    ranks = sizes.select(*_KEYS, "n").mapInPandas(draw, "column string, grp string, draw int, low long, high long")
    both = ranks.select(*_KEYS, "draw", F.explode(F.array("low", "high")).alias("rank"))
    found = _values_at_ranks(counted, both.select(*_KEYS, "rank").distinct())
    return null_safe_join(both, found, [*_KEYS, "rank"]).groupBy(*_KEYS, "draw").agg(F.avg("value").alias("median"))


def _limits(draws: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    # A group has exactly as many rows here as there were draws.
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(q.alias("q")).select(
        *keys, F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper")
    )


def median_intervals(
    df: DataFrame, group: str, targets: Sequence[str], draws: int = DRAWS, seed: int = 42
) -> DataFrame:
    """95 % bootstrap interval of each group median."""
    return _limits(median_draws(grouped_values(df, group, targets), draws, seed), "median", _KEYS)


def undrawn_groups(df: DataFrame, group: str, targets: Sequence[str]) -> DataFrame:
    """(column, grp, n, median, reason) of the groups with too few values for a bootstrap interval."""
    long = grouped_values(df, group, targets)
    sizes = long.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MIN_VALUES)
    few = attach(long, sizes, _KEYS)
    medians = few.groupBy(*_KEYS, "n").agg(F.median("value").alias("median"))
    return medians.withColumn("reason", F.format_string("%d values, at least %d are needed", "n", F.lit(MIN_VALUES)))


def median_difference_interval(
    df: DataFrame, group: str, first: str, second: str, target: str, draws: int = DRAWS, seed: int = 42
) -> DataFrame:
    """95 % bootstrap interval of the difference of two group medians."""
    two = df.where(F.col(f"`{group}`").cast("string").isin(first, second))
    sampled = median_draws(grouped_values(two, group, [target]), draws, seed)
    a = sampled.where(F.col("grp") == first).select("draw", F.col("median").alias("a"))
    b = sampled.where(F.col("grp") == second).select("draw", F.col("median").alias("b"))
    gaps = a.join(b, "draw").select(F.lit(target).alias("column"), (F.col("a") - F.col("b")).alias("gap"))
    return _limits(gaps, "gap", ["column"])
