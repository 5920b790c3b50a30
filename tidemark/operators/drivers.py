"""Drivers of a target column, and bottlenecks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import percent
from tidemark.functions.summaries import summarise
from tidemark.functions.types import as_double, numeric_columns, require_columns, string_columns
from tidemark.operators.correlation import correlation_interval, pair_correlation
from tidemark.operators.hypothesis import benjamini_hochberg, compare_groups
from tidemark.plans.quantiles import SMALL_VALUES, quantiles

# Name parts of target and load columns (fixed values).
TARGET_WORDS = ["capacity", "util", "load", "demand", "pipeline"]
LOAD_WORDS = [
    "capacity", "util", "load", "throughput", "pipeline", "flow", "rate", "volume", "demand", "usage", "consumption",
    "quantity", "amount", "traffic", "bandwidth", "pressure", "temperature", "efficiency", "performance", "speed",
    "power", "production", "output", "input", "delivery", "supply", "peak", "max", "min",
]


def pick_target(df: DataFrame) -> str:
    """The first numeric column named like a load, else the first numeric column."""
    numbers = numeric_columns(df)
    if len(numbers) < 2:
        raise ValueError("need at least two numeric columns")
    return next((c for c in numbers if any(w in c.lower() for w in TARGET_WORDS)), numbers[0])


def numeric_drivers(
    df: DataFrame, target: str | None = None, min_correlation: float = 0.3, min_rows: int = 30
) -> DataFrame:
    """Numeric columns correlated with the target, with Fisher intervals; one pass."""
    target = pick_target(df) if target is None else target
    predictors = numeric_columns(df, exclude=[target])
    require_columns(df, [target])

    def stats(c: str) -> dict:
        n, r = pair_correlation(as_double(df, target), as_double(df, c))
        return {"sample_size": n, "correlation": r}

    r, n = F.col("correlation"), F.col("sample_size")
    low, high = correlation_interval(r, n)
    return (
        summarise(df, predictors, stats)
        .where((n >= min_rows) & ~F.isnan(r) & (F.abs(r) >= min_correlation))
        .select(
            F.col("column").alias("factor"),
            "correlation",
            F.when(r > 0, "positive").otherwise("negative").alias("relationship"),
            F.when(F.abs(r) >= 0.7, "strong").otherwise("moderate").alias("strength"),
            "sample_size",
            low.alias("ci_lower"),
            high.alias("ci_upper"),
        )
    )


def category_candidates(df: DataFrame, min_levels: int = 2, max_levels: int = 10) -> list[str]:
    """Text columns with a number of distinct values in the range."""
    texts = string_columns(df)
    if not texts:
        return []
    counts = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    return [c for i, c in enumerate(texts) if min_levels <= counts[f"d{i}"] <= max_levels]


def category_drivers(
    df: DataFrame,
    target: str | None = None,
    categories: Sequence[str] | None = None,
    min_rows: int = 10,
    levels: tuple[int, int] = (2, 10),
) -> DataFrame:
    """Does the target differ between the levels of each category?  BH-corrected."""
    target = pick_target(df) if target is None else target
    categories = category_candidates(df, *levels) if categories is None else list(categories)
    if not categories:
        raise ValueError(f"no category column with {levels[0]} to {levels[1]} levels")
    tests = None
    for c in categories:
        one = compare_groups(df, c, [target], min_size=min_rows).withColumn("column", F.lit(c))
        tests = one if tests is None else tests.union(one)
    return benjamini_hochberg(tests.withColumnRenamed("column", "factor"))


def driver_confidence(found: DataFrame) -> DataFrame:
    """Confidence from the number of significant tests: two high, one medium, none low."""
    hits = F.count_if(F.col("significant_corrected"))
    return found.agg(
        F.count(F.lit(1)).alias("tests"),
        hits.alias("significant_tests"),
        F.when(hits >= 2, "high").when(hits == 1, "medium").otherwise("low").alias("confidence"),
    )


def most_variable(df: DataFrame, k: int = 8) -> list[str]:
    """The ``k`` numeric columns of largest variance, constant ones left out."""
    spread = summarise(df, numeric_columns(df), lambda c: {"v": F.var_samp(as_double(df, c))})
    return [r["column"] for r in spread.where("v > 0").orderBy(F.desc("v"), "column").limit(k).collect()]


def bottlenecks(
    df: DataFrame, columns: Sequence[str] | None = None, small_values: int = SMALL_VALUES, k: int = 8
) -> DataFrame:
    """Rows far above the usual load of each column: count, severity, frequency and score.

    Default columns are those named like a load, else the ``k`` most variable.
    """
    if columns is None:
        named = [c for c in numeric_columns(df) if any(w in c.lower() for w in LOAD_WORDS)]
        columns = named or most_variable(df, k)
    require_columns(df, columns)
    if not columns:
        raise ValueError("no numeric columns")
    q = quantiles(df, columns, {"q1": 0.25, "q3": 0.75}, small_values=small_values)
    # One row per column: limits become literals of the second pass.
    limits = {r["column"]: (r["q3"], r["q3"] + 1.5 * (r["q3"] - r["q1"])) for r in q.collect()}

    def stats(c: str) -> dict:
        x = as_double(df, c)
        q3, top = (F.lit(v).cast("double") for v in limits.get(c, (None, None)))
        return {
            "rows": F.count(F.lit(1)),
            "std": F.stddev_samp(x),
            "threshold": F.max(top),
            "bottleneck_instances": F.count_if(x > top),
            "mean_normal": F.avg(F.when(x <= q3, x)),
            "mean_bottleneck": F.avg(F.when(x > top, x)),
            "max_observed": F.max(x),
        }

    severity = F.coalesce(
        (F.col("mean_bottleneck") - F.col("mean_normal")) / F.nullif(F.col("mean_normal"), F.lit(0.0)), F.lit(0.0)
    )
    hits = F.col("bottleneck_instances")
    return (
        summarise(df, columns, stats)
        .where((F.col("std") > 0) & (hits > 0))
        .select(
            F.col("column").alias("metric"),
            "bottleneck_instances",
            "threshold",
            severity.alias("severity_ratio"),
            "mean_normal",
            "mean_bottleneck",
            "max_observed",
            percent(hits, F.col("rows")).alias("frequency_pct"),
            (severity * hits / F.col("rows")).alias("bottleneck_score"),
        )
    )


def all_drivers(df: DataFrame, target: str | None = None) -> DataFrame:
    """Both kinds of driver in one table (factor, kind, measure, p_value)."""
    numbers = numeric_drivers(df, target).select(
        "factor", F.lit("correlation").alias("kind"), F.col("correlation").alias("measure"),
        F.lit(None).cast("double").alias("p_value"),
    )
    groups = category_drivers(df, target).where("significant_corrected").select(
        "factor", F.lit("group_difference"), "statistic", "p_value"
    )
    return numbers.union(groups)

