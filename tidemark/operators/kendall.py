"""Kendall's tau-b from a distributed count of inversions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import normal_tail
from tidemark.functions.types import as_double, numeric_columns, require_columns
from tidemark.operators.correlation import _describe_pairs, _pairs, approximate_interval
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.ordered import prefix_sums, with_position
from tidemark.plans.shipping import ship_package
from tidemark.plans.storage import freeze

BLOCK_ROWS = 200_000
_BITS = 4
_DIGITS = 1 << _BITS
EXACT_MAX = 33


def weighted_inversions(ranks: np.ndarray, weights: np.ndarray) -> float:
    """Sum of w_i·w_j over i < j with ranks_i > ranks_j, one bit of the rank at a time."""
    ranks = np.unique(ranks, return_inverse=True)[1]
    weights = np.asarray(weights, dtype=float)
    total = 0.0
    for bit in range(int(ranks.max(initial=0)).bit_length()):
        prefix = ranks >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        p, w, high = prefix[order], weights[order], (ranks[order] >> bit) & 1 == 1
        running = np.cumsum(np.where(high, w, 0.0))
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        base = np.r_[0.0, running][starts]
        before = running - np.repeat(base, np.diff(np.r_[starts, len(p)]))
        total += float((w * before)[~high].sum())
    return total


def _inversions(cells: DataFrame, block_rows: int) -> DataFrame:
    """Discordant pairs per column pair: (pair, d).

    Rows in (x, y) order are cut into blocks.  Pairs inside a block are counted in
    one task; pairs across blocks are counted where the ranks of y first differ,
    digit by digit, from counts per block.  A tie in x or y is never an inversion.
    """
    distinct_y = cells.select("pair", "y").distinct()
    y_rank = with_position(distinct_y, ["y"], ["pair"], pos="yr", size="levels").select("pair", "y", "yr")
    placed = freeze(
        with_position(attach(cells, y_rank, ["pair", "y"]), ["x", "y"], ["pair"]).withColumn(
            "block", F.floor(F.col("pos") / block_rows)
        )
    )

    def inside(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values("pos")
        d = weighted_inversions(ordered["yr"].to_numpy(), ordered["c"].to_numpy())
        return pd.DataFrame({"pair": [key[0]], "d": [d]})

    local = (
        placed.select("pair", "block", "pos", "yr", "c").groupBy("pair", "block").applyInPandas(inside, "pair int, d double")
    )
    reach = placed.agg(F.max("block").alias("block"), F.max("yr").alias("yr")).first()
    if reach["block"] is None or reach["block"] == 0:
        return local.groupBy("pair").agg(F.sum("d").alias("d"))
    levels = max(1, math.ceil(int(reach["yr"]).bit_length() / _BITS))
    digits = F.array(
        *[
            F.struct(
                F.lit(k).alias("level"),
                F.shiftright("yr", _BITS * (k + 1)).alias("prefix"),
                F.shiftright("yr", _BITS * k).bitwiseAND(F.lit(_DIGITS - 1)).alias("digit"),
            )
            for k in range(levels)
        ]
    )
    counts = (
        placed.select("pair", "block", "c", F.inline(digits))
        .groupBy("pair", "level", "prefix", "block")
        .agg(*[F.sum(F.when(F.col("digit") == v, F.col("c")).otherwise(0)).alias(f"s{v}") for v in range(_DIGITS)])
    )
    running = prefix_sums(
        counts, ["pair", "level", "prefix"], ["block"], {f"r{v}": f"s{v}" for v in range(_DIGITS)}
    )
    larger = F.lit(0.0)
    crossing = F.lit(0.0)
    for v in reversed(range(_DIGITS)):
        crossing = crossing + F.col(f"s{v}").cast("double") * larger
        larger = larger + F.col(f"r{v}").cast("double")
    across = running.groupBy("pair").agg(F.sum(crossing).alias("d"))
    return local.union(across).groupBy("pair").agg(F.sum("d").alias("d"))


def _tail(discordant: float, n: float, s: float, variance: float, tied: bool) -> float:
    pairs = n * (n - 1) / 2
    if not tied and n <= EXACT_MAX:
        least = int(min(discordant, pairs - discordant))
        counts = np.ones(1)
        for k in range(2, int(n) + 1):
            counts = np.convolve(counts, np.ones(k))
        return min(1.0, 2.0 * float(counts[: least + 1].sum() / counts.sum()))
    return min(1.0, 2.0 * normal_tail(abs(s) / math.sqrt(variance))) if variance > 0 else 1.0


def _p_value(*columns: Column) -> Column:
    @F.pandas_udf("double")
    def evaluate(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([_tail(*row[:4], bool(row[4])) for row in frame.to_numpy(dtype=float)])

    return evaluate(F.struct(*[c.cast("double").alias(f"a{i}") for i, c in enumerate(columns)]))


def kendall(df: DataFrame, columns: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kendall's tau-b of every column pair; exact p-values for up to 33 rows without ties."""
    ship_package(df.sparkSession)
    columns = numeric_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    pairs = _pairs(columns)
    # The number of discordant pairs is the same with the sides exchanged, and costs a step for each digit of the second
    # side's ranks: that side is the column with fewer values, by an estimate.
    levels = df.agg(*[F.approx_count_distinct(as_double(df, c)).alias(f"l{i}") for i, c in enumerate(columns)]).first()
    many = {c: levels[f"l{i}"] for i, c in enumerate(columns)}
    sides = [(a, b) if many[a] >= many[b] else (b, a) for a, b in pairs]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"), (as_double(df, a) + 0).alias("x"), (as_double(df, b) + 0).alias("y")
            )
            for i, (a, b) in enumerate(sides)
        ]
    )
    cells = freeze(
        df.select(F.inline(rows))
        .where("x is not null and y is not null")
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).alias("c"))
    )

    def ties(side: str) -> DataFrame:
        t = F.col("t").cast("double")
        return (
            cells.groupBy("pair", side)
            .agg(F.sum("c").alias("t"))
            .groupBy("pair")
            .agg(
                F.sum(t * (t - 1) / 2).alias(f"{side}_pairs"),
                F.sum(t * (t - 1) * (t - 2)).alias(f"{side}0"),
                F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{side}1"),
            )
        )

    c = F.col("c").cast("double")
    both = cells.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(c * (c - 1) / 2).alias("both_pairs"))
    facts = _inversions(cells, block_rows)
    for part in (both, ties("x"), ties("y")):
        facts = null_safe_join(facts, part, ["pair"])
    n = F.col("n").cast("double")
    m = n * (n - 1)
    s = m / 2 - F.col("x_pairs") - F.col("y_pairs") + F.col("both_pairs") - 2 * F.col("d")
    scale = F.sqrt((m / 2 - F.col("x_pairs")) * (m / 2 - F.col("y_pairs")))
    variance = (
        (m * (2 * n + 5) - F.col("x1") - F.col("y1")) / 18
        + 2 * F.col("x_pairs") * F.col("y_pairs") / F.nullif(m, F.lit(0.0))
        + F.col("x0") * F.col("y0") / F.nullif(9 * m * (n - 2), F.lit(0.0))
    )
    names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])[F.col("pair")]
    found = facts.select(
        names[0].alias("column1"),
        names[1].alias("column2"),
        F.col("n").alias("sample_size"),
        (s / F.nullif(scale, F.lit(0.0))).alias("correlation"),
        "d",
        s.alias("s"),
        F.coalesce(variance, F.lit(0.0)).alias("variance"),
        ((F.col("x_pairs") + F.col("y_pairs")) > 0).cast("int").alias("tied"),
    )
    p = _p_value(F.col("d"), F.col("sample_size"), F.col("s"), F.col("variance"), F.col("tied"))
    r = F.col("correlation")
    return _describe_pairs(found, "kendall", p, approximate_interval(r, F.col("sample_size")))
