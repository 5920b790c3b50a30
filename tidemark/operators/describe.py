"""Descriptive statistics of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import percent, sample_kurtosis, sample_skewness, share
from tidemark.functions.summaries import summarise
from tidemark.functions.types import (
    datetime_columns,
    is_missing,
    numeric_columns,
    string_columns,
    type_group,
)
from tidemark.operators.aggregate import duplicate_rows
from tidemark.operators.frequencies import most_frequent, text_frequencies
from tidemark.plans.joining import null_safe_join
from tidemark.plans.quantiles import SMALL_VALUES, melt, quantiles
from tidemark.plans.storage import freeze


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns per group, missing cells, completeness % and duplicate rows."""
    cols = df.columns
    missing = sum((is_missing(df, c).cast("long") for c in cols), F.lit(0).cast("long"))
    one = df.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"))
    cells = F.col("total_rows") * len(cols)
    counted = one.select(
        "total_rows",
        F.lit(len(cols)).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(string_columns(df))).alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).alias("datetime_columns"),
        "missing_cells",
        percent(cells - F.col("missing_cells"), cells).alias("completeness_score"),
    )
    # Both sides hold exactly one row.
    return counted.withColumn("__k", F.lit(1)).join(duplicate_rows(df).withColumn("__k", F.lit(1)), "__k").drop("__k")


def numeric_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, moments, extremes and sign counts per column.

    In long form one compact aggregation serves all columns; side by side, the
    aggregates of many columns outgrow generated code.
    """
    v = F.col("value")
    return melt(df, columns).groupBy("column").agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        sample_skewness(v).alias("skewness"),
        sample_kurtosis(v).alias("kurtosis"),
        F.count_if(v == 0).alias("zero_count"),
        F.count_if(v < 0).alias("negative_count"),
        F.count_if(v > 0).alias("positive_count"),
    )


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, small_values: int = SMALL_VALUES, accuracy: int | None = None
) -> DataFrame:
    """Count, mean, deviation, extremes, skewness, kurtosis and quartiles per column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    moments = numeric_moments(df, columns).drop("zero_count", "negative_count", "positive_count")
    q = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, small_values=small_values, accuracy=accuracy)
    return null_safe_join(moments, q, ["column"]).withColumn("median", F.col("q50"))


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, top value (tie: smallest), its frequency, cardinality ratio."""
    columns = string_columns(df) if columns is None else list(columns)
    freq = freeze(text_frequencies(df, columns))
    sizes = freq.groupBy("column").agg(F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"))
    top = most_frequent(df, freq).select("column", F.col("value").alias("top_value"), F.col("count").alias("top_freq"))
    found = null_safe_join(sizes, top, ["column"])
    rows = summarise(df, columns, lambda c: {"rows": F.count(F.lit(1))})
    return null_safe_join(rows, found, ["column"], "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("unique", F.lit(0)).alias("unique"),
        "top_value",
        F.coalesce("top_freq", F.lit(0)).alias("top_freq"),
        F.coalesce(share(F.col("unique"), F.col("rows")), F.lit(0.0)).alias("cardinality_ratio"),
    )


def describe_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, first and last moment, whole days between them, distinct moments."""
    columns = datetime_columns(df) if columns is None else list(columns)

    def stats(c: str) -> dict:
        moment = F.col(f"`{c}`").cast("timestamp_ntz")
        seconds = F.timestamp_diff("SECOND", F.min(moment), F.max(moment))
        return {
            "count": F.count(moment),
            "min_date": F.min(moment),
            "max_date": F.max(moment),
            "range_days": F.floor(seconds / 86400).cast("long"),
            "unique_dates": F.count_distinct(moment),
        }

    return summarise(df, columns, stats).where("count > 0")


def missing_by_column(df: DataFrame) -> DataFrame:
    return summarise(
        df,
        df.columns,
        lambda c: {
            "missing": F.count_if(is_missing(df, c)),
            "missing_pct": percent(F.count_if(is_missing(df, c)), F.count(F.lit(1))),
        },
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Total missing cells, columns affected and the worst column (tie: first)."""
    place = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    worst = F.struct(F.col("missing"), -place[F.col("column")])
    any_missing = F.sum("missing") > 0
    return missing_by_column(df).agg(
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.when(any_missing, F.max_by("column", worst)).alias("most_missing_column"),
        F.when(any_missing, F.max("missing_pct")).otherwise(0.0).alias("most_missing_percentage"),
    )


def describe_dataset(df: DataFrame) -> dict[str, DataFrame]:
    """The whole description in one call, each part its own lazy table."""
    parts = {
        "overview": overview(df),
        "types": type_counts(df),
        "missing": missing_by_column(df),
        "missing_summary": missing_summary(df),
    }
    if numeric_columns(df):
        parts["numeric"] = describe_numeric(df)
    if string_columns(df):
        parts["categorical"] = describe_categorical(df)
    if datetime_columns(df):
        parts["datetime"] = describe_datetime(df)
    return parts


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type and the groups they fall in (schema only)."""
    rows = [(f.dataType.simpleString(), type_group(df, f.name)) for f in df.schema]
    listed = df.sparkSession.createDataFrame(rows, "type string, type_group string")
    return listed.groupBy("type", "type_group").agg(F.count(F.lit(1)).alias("columns"))
