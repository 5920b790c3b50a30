"""Bootstrap of any statistic of sums by replicate weights.

A resample of n rows gives each row a count that is close to Poisson(1).  So a replicate
needs no resampling: each row draws its weight for each replicate from a hash of what names
the row, and one aggregation keyed by group and replicate adds up the weighted sums.  A task
draws the weights of some rows and all replicates as one small array and adds them up at
once, so no row for each row and replicate is ever made; the shuffle carries one row for each
group, replicate and batch at most.  The hash is integer arithmetic that any SQL engine
repeats, so draws depend neither on partitions nor on the order of rows.

Defined results: rows without a value (or without a place, for a trend) take no part; null
groups have no interval; rows with equal names share their weights; a replicate in which the
statistic has no value is left out and ``replicates`` says how many count; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_double, require_columns
from tidemark.plans.joining import attach
from tidemark.plans.shipping import ship_package
from tidemark.plans.storage import freeze

DRAWS = 200
MODULUS = (1 << 31) - 1
# Multipliers of the hash, and the most often a row may be drawn.
MULTIPLIERS = (48271, 69621, 16807)
MOST = 12
# Weights drawn at once: arrays of so many entries stay in a core's cache.
WEIGHTS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class Statistic:
    """``sums`` are added up over a replicate by weight; ``value`` is computed from them.

    A sum is a function of the centred value ``y`` and the centred place ``x``; the value is
    a function of the sums, the weight ``w`` and the two centres.
    """

    sums: Mapping[str, Callable[[Column, Column], Column]]
    value: Callable[[Mapping[str, Column]], Column]
    has_place: bool = False


MEAN = Statistic({"y": lambda y, x: y}, lambda s: s["centre"] + s["y"] / s["w"])
DEVIATION = Statistic(
    {"y": lambda y, x: y, "yy": lambda y, x: y * y},
    lambda s: F.sqrt(F.greatest(F.lit(0.0), s["yy"] - s["y"] * s["y"] / s["w"]) / F.nullif(s["w"] - 1, F.lit(0.0))),
)
SLOPE = Statistic(
    {"x": lambda y, x: x, "y": lambda y, x: y, "xy": lambda y, x: x * y, "xx": lambda y, x: x * x},
    lambda s: (s["xy"] - s["x"] * s["y"] / s["w"]) / F.nullif(s["xx"] - s["x"] * s["x"] / s["w"], F.lit(0.0)),
    has_place=True,
)


def poisson_limits(most: int = MOST) -> list[int]:
    """The hash values from which a row is drawn at least once, twice, ..., ``most`` times."""
    out, term, below = [], math.exp(-1.0), 0.0
    for k in range(1, most + 1):
        below += term
        term /= k
        out.append(round(below * MODULUS))
    return out


def row_seed(names: Sequence[str], seed: int) -> Column:
    """A number below 2^28 from the columns that name a row."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]).cast("binary"))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def weight(row: Column, draw: Column) -> Column:
    """How often a row is drawn in a replicate."""
    a, b, c = MULTIPLIERS
    first = ((row + 1) * a % MODULUS).bitwiseXOR((draw + 1) * b * a % MODULUS) * c % MODULUS
    # arrays of one entry name what is used several times, which the optimizer would otherwise copy out
    last = F.transform(F.array(first), lambda m: m.bitwiseXOR(F.shiftright(m, 15)) * a % MODULUS)
    none, *more = poisson_limits()
    times = F.transform(last, lambda h: sum(((h >= limit).cast("int") for limit in more), (h >= none).cast("int")))
    return F.aggregate(times, F.lit(0), lambda total, t: total + t)


def _reduced(product: np.ndarray) -> np.ndarray:
    """Remainders by ``MODULUS``, which is one less than a power of two, of numbers below 2^62."""
    folded = ((product & MODULUS) + (product >> 31)).astype(np.uint32)
    return np.minimum(folded, folded - np.uint32(MODULUS))


def weight_table(rows: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """``weight`` of all given replicates (down) and rows (across), as small integers."""
    a, b, c = MULTIPLIERS
    of_row, of_draw = (rows.astype(np.int64) + 1) * a % MODULUS, (draws.astype(np.int64) + 1) * b * a % MODULUS
    m = _reduced((of_draw[:, None] ^ of_row[None, :]) * c)
    h = _reduced((m ^ (m >> np.uint32(15))).astype(np.int64) * a).view(np.int32)
    out = np.zeros(h.shape, np.uint8)
    for limit in poisson_limits():
        out += (h >= np.int32(limit)).view(np.uint8)
    return out


def _adder(schema: pa.Schema, draws: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums by group and replicate of (grp, row, summands): one row for each of a batch in which a row is drawn."""
    replicate, step = np.arange(draws), max(1, WEIGHTS_AT_ONCE // max(draws, 1))

    def added(rows: np.ndarray, summands: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
        drawn = np.zeros(draws)
        totals, counted = [np.zeros(draws) for _ in summands], [np.zeros(draws) for _ in summands]
        values = [s.fill_null(0.0).to_numpy(zero_copy_only=False) for s in summands]
        known = [s.is_valid().to_numpy(zero_copy_only=False) if s.null_count else None for s in summands]
        finite = [bool(np.isfinite(v).all()) for v in values]
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            w = weight_table(rows[part], replicate).astype(float)
            drawn += w.sum(axis=1)
            for k, v in enumerate(values):
                # a row that is not drawn adds nothing, an infinite value of it neither
                totals[k] += np.einsum("dr,r->d", w, v[part]) if finite[k] else np.where(w > 0, w * v[part], 0.0).sum(axis=1)
                if known[k] is not None:
                    counted[k] += np.einsum("dr,r->d", w, known[k][part].astype(float))
        # like a sum in SQL, one without a known value is null
        nulls = [counted[k] == 0 if known[k] is not None else None for k in range(len(summands))]
        return drawn, [pa.array(t, mask=m) for t, m in zip(totals, nulls)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("grp").dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
            for g, (start, end) in enumerate(zip(np.r_[0, ends], ends)):
                own = batch.take(pa.array(order[start:end]))
                drawn, totals = added(own.column("row").to_numpy(), [own.column(i) for i in range(2, own.num_columns)])
                names = pa.array([coded.dictionary[g].as_py()] * draws, pa.string())
                full = pa.RecordBatch.from_arrays([names, pa.array(replicate, pa.int32()), pa.array(drawn), *totals], schema=schema)
                yield full.filter(pa.array(drawn > 0))

    return add


def bootstrap_draws(
    df: DataFrame,
    target: str,
    names: Sequence[str],
    statistic: Statistic = MEAN,
    group: str | None = None,
    place: str | None = None,
    draws: int = DRAWS,
    seed: int = 42,
) -> DataFrame:
    """(grp, draw, value): the statistic of each replicate of each group."""
    require_columns(df, [target, *names, *([group] if group else []), *([place] if place else [])])
    if statistic.has_place and place is None:
        raise ValueError("this statistic needs a place column")
    where = as_double(df, place) if place else F.lit(0.0)
    by = F.col(f"`{group}`").cast("string") if group else F.lit("all")
    rows = df.select(by.alias("grp"), row_seed(names, seed).alias("row"), as_double(df, target).alias("y"), where.alias("x"))
    rows = rows.where("grp is not null and y is not null and x is not null and not isnan(y) and not isnan(x)")
    centres = freeze(rows.groupBy("grp").agg(F.avg("y").alias("centre"), F.avg("x").alias("middle")))
    centred = attach(rows, centres, ["grp"], stored=True)
    y, x = F.col("y") - F.col("centre"), F.col("x") - F.col("middle")
    sums = {name: fn(y, x) for name, fn in statistic.sums.items()}
    ship_package(df.sparkSession)
    each = centred.select("grp", "row", *[c.cast("double").alias(f"s_{name}") for name, c in sums.items()])
    parts = ["w", *[f"t_{name}" for name in sums]]
    schema = pa.schema([("grp", pa.string()), ("draw", pa.int32()), *[(c, pa.float64()) for c in parts]])
    weighed = each.mapInArrow(_adder(schema, draws), ", ".join(["grp string", "draw int", *[f"`{c}` double" for c in parts]]))
    added = weighed.groupBy("grp", "draw").agg(*[F.sum(f"`{c}`").alias(c) for c in parts])
    known = {"w": F.col("w"), "centre": F.col("centre"), "middle": F.col("middle"), **{name: F.col(f"t_{name}") for name in sums}}
    return attach(added, centres, ["grp"], stored=True).select("grp", "draw", statistic.value(known).alias("value"))


def bootstrap(
    df: DataFrame,
    target: str,
    names: Sequence[str],
    statistic: Statistic = MEAN,
    group: str | None = None,
    place: str | None = None,
    draws: int = DRAWS,
    seed: int = 42,
    level: float = 0.95,
) -> DataFrame:
    """(grp, replicates, mean, error, ci_lower, ci_upper) of a statistic by replicate weights."""
    found = bootstrap_draws(df, target, names, statistic, group, place, draws, seed).where("value is not null")
    tail = (1.0 - level) / 2
    # a group has at most as many rows here as there are replicates
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1.0 - tail)))
    return found.groupBy("grp").agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("error"), q.alias("q")
    ).select("grp", "replicates", "mean", "error", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))
