"""Grouped aggregation, value counts, crosstabs and distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_double, numeric_columns, require_columns
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.quantiles import SMALL_VALUES, long_quantiles, melt

DEFAULT_FUNCTIONS = ("count", "mean", "median", "std", "min", "max")


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def aggregate(
    df: DataFrame,
    group_by: str | Sequence[str],
    column: str,
    functions: Sequence[str] = DEFAULT_FUNCTIONS,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Aggregate one column per group; rows with a null key are left out."""
    keys = [group_by] if isinstance(group_by, str) else list(group_by)
    require_columns(df, [*keys, column])
    numeric = column in numeric_columns(df)
    x = as_double(df, column) if numeric else F.col(f"`{column}`")
    available = {"count": F.count(x)}
    if numeric:
        available |= {
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
            "sum": F.sum(x),
        }
    unknown = [f for f in functions if f not in available and not (f == "median" and numeric)]
    if unknown:
        raise ValueError(f"no aggregation {unknown} for column {column}")
    grouped = _present(df, keys)
    simple = [f for f in functions if f != "median"]
    out = grouped.groupBy(*keys).agg(*[available[f].alias(f) for f in simple] or [F.count(F.lit(1)).alias("__rows")])
    if "median" in functions:
        medians = long_quantiles(melt(grouped, [column], keys), [*keys, "column"], {"median": 0.5}, small_values)
        out = null_safe_join(out, medians.drop("column"), keys, "left")
    return out.select(*keys, *functions)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count per value, nulls counted as a value."""
    require_columns(df, [column])
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """Most frequent values; ties by value, null last."""
    return value_frequencies(df, column).orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top_n)


def count_analysis(df: DataFrame, column: str) -> DataFrame:
    """One row: totals, distinct values, and the most and least frequent value.

    Ties go to the smallest value for the most frequent and to the largest for
    the least frequent (the two ends of one ordering); null counts as a value.
    """
    freq = value_frequencies(df, column)
    n = F.col("count")
    text = F.col("value").cast("string")
    order = F.struct(-n, F.col("value").isNull(), F.col("value"))
    return freq.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), n)), F.lit(0)).alias("non_null_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.min_by(text, order).alias("most_frequent"),
        F.min_by(n, order).alias("most_frequent_count"),
        F.max_by(text, order).alias("least_frequent"),
        F.max_by(n, order).alias("least_frequent_count"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form, non-null pairs only."""
    require_columns(df, [a, b])
    return _present(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row.

    Rows are first counted by a 64-bit hash, which shuffles eight bytes per row;
    only rows whose hash repeats are then compared column by column.
    """
    scalars = df.columns
    hashed = df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in scalars]))
    repeated = hashed.groupBy("__h").count().where("count > 1").select("__h")
    suspects = hashed.join(repeated, "__h", "left_semi")
    groups = suspects.groupBy(*[F.col(f"`{c}`") for c in scalars]).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("duplicate_rows"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; exact unless ``approximate``."""
    require_columns(df, columns)
    count = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[count(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(columns)]
    )
    return one.select(F.inline(rows))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return _present(df, [group]).groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def robust_statistics(
    df: DataFrame, group: str, targets: Sequence[str], small_values: int = SMALL_VALUES
) -> DataFrame:
    """Median, quartiles, IQR, MAD, MAD/median and IQR fences per group and target."""
    long = melt(_present(df, [group]), targets, [group])
    keys = [group, "column"]
    q = long_quantiles(long, keys, {"q25": 0.25, "median": 0.5, "q75": 0.75}, small_values)
    spread = attach(long, q.select(*keys, "median"), keys).withColumn("value", F.abs(F.col("value") - F.col("median")))
    mad = long_quantiles(spread.select(*keys, "value"), keys, {"mad": 0.5}, small_values)
    iqr = F.col("q75") - F.col("q25")
    return null_safe_join(q, mad, keys).select(
        *keys,
        "median",
        "q25",
        "q75",
        iqr.alias("iqr"),
        "mad",
        F.when(F.col("median") == 0, F.lit(float("inf"))).otherwise(F.try_divide("mad", "median")).alias("robust_cv"),
        (F.col("q25") - 1.5 * iqr).alias("lower_fence"),
        (F.col("q75") + 1.5 * iqr).alias("upper_fence"),
    )
