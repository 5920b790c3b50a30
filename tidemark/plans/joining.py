"""Joining small statistics back to rows, with the size checked first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.storage import freeze

BROADCAST_BYTES = 32 << 20


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null matches null; keeps one copy of the keys.

    Keys that cannot be null on one side are compared plainly, so the join can use
    the partitioning a window or aggregation on the same keys left behind.
    """
    if not keys:
        raise ValueError("null_safe_join needs at least one key")

    def same(key: str) -> Column:
        a, b = F.col(f"`{key}`"), F.col(f"`__r_{key}`")
        can_be_null = left.schema[key].nullable and right.schema[key].nullable
        return a.eqNullSafe(b) if can_be_null else a == b

    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [same(k) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def stored_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a stored table take."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 16 * (len(df.columns) + 1)
    length = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts], F.lit(fixed))
    return df.agg(F.sum(length.cast("long")).alias("b")).first()["b"] or 0


def attach(
    rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner", stored: bool = False
) -> DataFrame:
    """Join per-key statistics to rows.

    The statistics are stored once, so checking their size does not compute them
    twice.  Up to ``BROADCAST_BYTES`` they are broadcast; beyond that the join
    shuffles, where adaptive execution splits hot keys.
    """
    kept = stats if stored else freeze(stats)
    small = stored_bytes(kept) <= BROADCAST_BYTES
    return null_safe_join(rows, F.broadcast(kept) if small else kept, keys, how)
