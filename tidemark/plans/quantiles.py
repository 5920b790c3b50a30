"""Exact quantiles and rank look-ups without holding a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_double
from tidemark.plans.ordered import prefix_sums
from tidemark.plans.storage import freeze

# Up to this many distinct (key, value) pairs Spark's own `percentile` is used: they
# bound the value map its tasks hold.
SMALL_VALUES = 200_000

# A sketch places a quantile within 1 / SKETCH_ACCURACY of the rows; a bracket reaches ten times as far to each side.
SKETCH_ACCURACY = 10_000
BRACKET_SHARE = 10 / SKETCH_ACCURACY


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (``by``…, ``column``, ``value``) of numeric columns, nulls dropped."""
    wide = df.select(*[F.col(f"`{b}`") for b in by], *[as_double(df, c).alias(f"__v_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`__v_{c}`").alias("value")) for c in columns])
    return wide.select(*[F.col(f"`{b}`") for b in by], F.inline(pairs)).where(F.col("value").isNotNull())


def value_counts(long: DataFrame, keys: Sequence[str], value: str = "value", count: str = "c") -> DataFrame:
    """One row per distinct value: equal values are merged before any shuffle."""
    # Adding zero merges -0.0 into 0.0, which sort apart but compare equal.
    return long.groupBy(*[F.col(f"`{k}`") for k in keys], (F.col(value) + 0).alias(value)).agg(
        F.count(F.lit(1)).alias(count)
    )


def running_counts(counts: DataFrame, keys: Sequence[str], value: str = "value", count: str = "c") -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` per key."""
    return prefix_sums(counts, keys, [value], {"before": count}, {"total": count})


def _at(position: Column, value: Column) -> Column:
    covers = (F.col("before") <= position) & (position < F.col("before") + F.col("c"))
    return F.max(F.when(covers, value))


def quantiles_of_counts(counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from ``running_counts`` output."""
    picks, outs = [], []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        picks += [
            _at(F.floor(spot), F.col("value")).alias(f"__lo_{name}"),
            _at(F.ceil(spot), F.col("value")).alias(f"__hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"__f_{name}"),
        ]
        lo, hi, frac = (F.col(f"__{part}_{name}") for part in ("lo", "hi", "f"))
        outs.append((lo + (hi - lo) * frac).alias(name))
    grouped = counted.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*picks)
    return grouped.select(*[F.col(f"`{k}`") for k in keys], *outs)


def count_quantiles(
    counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float], small_values: int = SMALL_VALUES
) -> DataFrame:
    """Exact quantiles from stored value counts (keys, ``value``, ``c``).

    Few distinct values go to ``percentile``; more are range-partitioned and located
    by running counts.
    """
    key_cols = [F.col(f"`{k}`") for k in keys]
    if counts.count() > small_values:
        return quantiles_of_counts(running_counts(counts, keys), keys, probs)
    points = F.array(*[F.lit(float(p)) for p in probs.values()])
    grouped = counts.groupBy(*key_cols).agg(F.percentile("value", points, F.col("c")).alias("__q"))
    return grouped.select(*key_cols, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)])


def long_quantiles(
    long: DataFrame,
    keys: Sequence[str],
    probs: Mapping[str, float],
    small_values: int = SMALL_VALUES,
    accuracy: int | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per key, one output column per probability.

    Rows are merged to value counts and stored, in one pass over the input.  With
    ``accuracy`` the caller accepts ``percentile_approx`` instead.
    """
    if accuracy is None:
        return count_quantiles(freeze(value_counts(long, keys)), keys, probs, small_values)
    key_cols = [F.col(f"`{k}`") for k in keys]
    points = F.array(*[F.lit(float(p)) for p in probs.values()])
    grouped = long.groupBy(*key_cols).agg(F.percentile_approx("value", points, accuracy).alias("__q"))
    return grouped.select(*key_cols, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)])


def brackets(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[tuple[float, float]]]:
    """Per column, ascending ranges of values that hold the rows at each probability and their neighbours.

    One pass with a mergeable sketch per column.  A column of fewer rows than the
    sketch's accuracy, where a bracket could end between two neighbours, has none.
    """
    ends = [end for p in sorted(probs) for end in (max(p - BRACKET_SHARE, 0.0), min(p + BRACKET_SHARE, 1.0))]
    found = df.agg(
        *[F.percentile_approx(as_double(df, c), ends, SKETCH_ACCURACY).alias(f"e{i}") for i, c in enumerate(columns)],
        *[F.count(as_double(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    out = {}
    for i, c in enumerate(columns):
        if found[f"n{i}"] < SKETCH_ACCURACY:
            continue
        ranges: list[tuple[float, float]] = []
        for low, high in zip(found[f"e{i}"][::2], found[f"e{i}"][1::2]):
            if ranges and low <= ranges[-1][1]:
                before = ranges.pop()
                low, high = before[0], max(high, before[1])
            ranges.append((low, high))
        out[c] = ranges
    return out


def narrowed(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Long form (``column``, ``value``) in which quantiles at ``probs`` are those of ``df``, with few distinct values.

    Values between two brackets are moved to the lower one's end, and values below all
    to the first one's start: rows keep their order, and those at the asked positions their values.
    """
    held = brackets(df, columns, probs)

    def moved(c: str) -> Column:
        v = as_double(df, c)
        if c not in held:
            return v
        first, *others = held[c]
        out = F.when(v.isNull(), v).when(v <= first[0], F.lit(first[0])).when(v <= first[1], v)
        last = first[1]
        for low, high in others:
            out = out.when(v < low, F.lit(last)).when(v <= high, v)
            last = high
        return out.otherwise(F.lit(last))

    return melt(df.select(*[moved(c).alias(c) for c in columns]), columns)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    small_values: int = SMALL_VALUES,
    accuracy: int | None = None,
) -> DataFrame:
    """Quantiles of several columns together: one row per (``by``…, ``column``).

    Without groups a sketch first narrows down which values have to be counted exactly.
    """
    if accuracy is None and not by and columns:
        return long_quantiles(narrowed(df, columns, list(probs.values())), ["column"], probs, small_values)
    return long_quantiles(melt(df, columns, by), [*by, "column"], probs, small_values, accuracy)


def scalar_quantiles(
    df: DataFrame, column: str, probs: Mapping[str, float], small_values: int = SMALL_VALUES
) -> dict[str, float]:
    """Quantiles of one column as driver values (one row)."""
    row = quantiles(df, [column], probs, small_values=small_values).first()
    return {name: (row[name] if row else None) for name in probs}
