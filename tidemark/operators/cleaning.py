"""Cleaning: duplicates, sparse and constant columns, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.summaries import summarise
from tidemark.functions.types import as_double, is_missing, numeric_columns, string_columns
from tidemark.operators.frequencies import most_frequent, text_frequencies
from tidemark.plans.ordered import forward_fill
from tidemark.plans.storage import freeze


def drop_sparse_columns(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Drop columns whose missing share exceeds ``threshold``."""
    shares = summarise(df, df.columns, lambda c: {"m": F.avg(is_missing(df, c).cast("int"))})
    return df.drop(*[r["column"] for r in shares.where(F.col("m") > threshold).collect()])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop columns with at most one distinct non-null value.

    Min equals max says the same as one distinct value, without a shuffle.
    """
    one = df.agg(
        *[
            (F.min(F.col(f"`{c}`")).eqNullSafe(F.max(F.col(f"`{c}`")))).alias(f"k{i}")
            for i, c in enumerate(df.columns)
        ]
    ).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if one[f"k{i}"]])


def fill_means_and_modes(df: DataFrame) -> DataFrame:
    """Numbers take the column mean, other columns their mode (tie: smallest).

    Columns with nothing missing stay as they are; a filled number column is double.
    """
    fills: dict[str, object] = {}
    numbers = numeric_columns(df)
    if numbers:
        measured = summarise(
            df, numbers, lambda c: {"v": F.avg(as_double(df, c)), "gaps": F.count_if(as_double(df, c).isNull())}
        )
        fills |= {r["column"]: r["v"] for r in measured.collect() if r["gaps"]}
    texts = string_columns(df)
    if texts:
        modes = most_frequent(df, freeze(text_frequencies(df, texts)))
        fills |= {r["column"]: r["value"] for r in modes.collect()}
    rest = [c for c in df.columns if c not in numbers and c not in texts]
    for c in rest:
        counted = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("value")).count()
        top = counted.orderBy(F.desc("count"), "value").first()
        fills[c] = top["value"] if top else None
    filled = {}
    for c in df.columns:
        if fills.get(c) is None:
            continue
        value = as_double(df, c) if c in numbers else F.col(f"`{c}`")
        filled[c] = F.coalesce(value, F.lit(fills[c]))
    return df.withColumns(filled) if filled else df


def handle_missing(
    df: DataFrame, strategy: str, order: Sequence[str] = (), keys: Sequence[str] = ()
) -> DataFrame:
    """``drop_rows``, ``forward_fill`` (in ``order``), ``mean_median`` or ``none``."""
    if strategy == "none":
        return df
    if strategy == "drop_rows":
        return df.dropna()
    if strategy == "forward_fill":
        if not order:
            raise ValueError("forward_fill needs an order")
        columns = [c for c in df.columns if c not in order and c not in keys]
        return forward_fill(df, columns, order, keys)
    if strategy == "mean_median":
        return fill_means_and_modes(df)
    raise ValueError(f"unknown missing-value strategy: {strategy}")


def clean(
    df: DataFrame,
    remove_duplicates: bool = True,
    missing_threshold: float = 0.9,
    remove_constant_columns: bool = True,
    missing_strategy: str = "none",
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Drop duplicate rows, sparse columns and constant columns, then handle missing values."""
    out = df.dropDuplicates() if remove_duplicates else df
    if missing_threshold < 1.0:
        out = drop_sparse_columns(out, missing_threshold)
    if remove_constant_columns:
        out = drop_constant_columns(out)
    return handle_missing(out, missing_strategy, order, keys)
