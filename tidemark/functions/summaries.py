"""Many per-column statistics from one aggregation, returned one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(
    df: DataFrame,
    columns: Sequence[str],
    stats: Callable[[str], dict[str, Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Evaluate ``stats(column)`` for every column in a single pass.

    All columns must give the same statistic names and types.
    """
    if not columns:
        raise ValueError("no columns to summarise")
    named = {c: stats(c) for c in columns}
    one = df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
        *[e.alias(f"__{i}_{s}") for i, c in enumerate(columns) for s, e in named[c].items()]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"`__{i}_{s}`").alias(s) for s in named[c]])
            for i, c in enumerate(columns)
        ]
    )
    return one.select(*[F.col(f"`{b}`") for b in by], F.inline(rows))
