"""Bounded, repeatable row samples for model fitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 31


def key_hash(keys: Sequence[str], seed: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(seed), *more, *[F.col(f"`{k}`") for k in keys])


def bounded_sample(
    df: DataFrame, keys: Sequence[str], size: int, total: int, seed: int, unique: bool = True
) -> DataFrame:
    """``size`` rows in random order (column ``__h``), chosen by a hash of ``keys``.

    Little more than ``size`` rows are left to sort; the choice does not depend on
    row order or partitioning.  Where ``keys`` do not identify rows (``unique`` is
    false) equal rows are merged first and so many copies of each drawn as its count
    and the wanted share call for.
    """
    share = min(1.0, 1.2 * size / max(total, 1))
    rows = df.withColumn("__n", F.lit(1).cast("long"))
    if not unique:
        rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    chance = F.pmod(key_hash(keys, seed + 1), F.lit(_SCALE)) / _SCALE
    wanted = F.col("__n") * F.lit(share)
    drawn = F.when(F.lit(share >= 1.0), F.col("__n")).otherwise(
        F.floor(wanted) + (chance < wanted - F.floor(wanted)).cast("long")
    )
    copies = rows.withColumn("__k", drawn).where("__k > 0")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__k"))))
    hashed = copies.withColumn("__h", key_hash(keys, seed, F.col("__copy"))).drop("__n", "__k", "__copy")
    return hashed.orderBy("__h").limit(size)
