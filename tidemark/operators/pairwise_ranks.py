"""Rank sums of all pairs of groups from one sorted table of value counts.

Groups are numbered and taken in chunks; values are cut into ranges of bounded size.  For
two chunks and one range a task merges the counts by value and multiplies: a value of one
group beats what lies below it in the other.  What lies in earlier ranges is added from the
totals of each range and group.  No list of groups reaches the driver and no task holds more
than a range of two chunks; the result alone has a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.shipping import ship_package
from tidemark.plans.storage import freeze

CHUNK = 256
RANGE_CELLS = 200_000
# Distinct values multiplied at once: two dense tables of so many rows and a chunk of columns.
STEP_VALUES = 2_000
_PAIRS = "i long, j long, u double, shared_ties double"


def _dense(rows: np.ndarray, groups: np.ndarray, counts: np.ndarray, height: int, chunk: int) -> np.ndarray:
    out = np.zeros((height, chunk))
    np.add.at(out, (rows, groups), counts)
    return out


def merged(side: np.ndarray, group: np.ndarray, value: np.ndarray, c: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, ties) of the groups of side 0 against those of side 1: wins with ties as halves, and 3 (a²b + ab²) over values."""
    _, place = np.unique(value, return_inverse=True)
    order = np.argsort(place, kind="stable")
    side, group, place, c = side[order], group[order], place[order], c[order].astype(float)
    u, ties, below = np.zeros((chunk, chunk)), np.zeros((chunk, chunk)), np.zeros(chunk)
    last = int(place[-1]) + 1 if len(place) else 0
    for at in range(0, last, STEP_VALUES):
        part = slice(np.searchsorted(place, at), np.searchsorted(place, at + STEP_VALUES))
        height = min(STEP_VALUES, last - at)
        a, b = (
            _dense(place[part][side[part] == s] - at, group[part][side[part] == s], c[part][side[part] == s], height, chunk)
            for s in (0, 1)
        )
        running = np.cumsum(b, axis=0)
        u += a.T @ (below + running - b / 2)
        ties += 3 * ((a * a).T @ b + a.T @ (b * b))
        below = below + running[-1]
    return u, ties


def _by_chunks(rows: DataFrame, chunks: int, chunk: int) -> DataFrame:
    """Each row for each pair of chunks it takes part in, as the first side or the second."""
    own = F.floor(F.col("gid") / chunk)
    as_first = F.transform(F.sequence(own, F.lit(chunks - 1).cast("long")), lambda k: F.struct(own.alias("p"), k.alias("q"), F.lit(0).alias("side")))
    as_second = F.transform(F.sequence(F.lit(0).cast("long"), own), lambda k: F.struct(k.alias("p"), own.alias("q"), F.lit(1).alias("side")))
    return rows.select(*rows.columns, F.inline(F.concat(as_first, as_second)))


def pair_sums(cells: DataFrame, groups: int, chunk: int = CHUNK, range_cells: int = RANGE_CELLS) -> DataFrame:
    """(i, j, u, shared_ties) for i < j of stored (gid, value, c) with numbers 0 to ``groups`` - 1, each in the table."""
    ship_package(cells.sparkSession)
    chunks = -(-groups // chunk)
    ranges = -(-cells.count() // range_cells)
    blocked = freeze(
        cells.select("gid", "value", "c").repartitionByRange(max(1, ranges), "value").withColumn("block", F.spark_partition_id())
    )

    def rows_of(p: int, q: int, u: np.ndarray, ties: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(known)
        out = pd.DataFrame({"i": i + p * chunk, "j": j + q * chunk, "u": u[i, j], "shared_ties": ties[i, j]})
        return out[out["i"] < out["j"]]

    def inside(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        group = (frame["gid"] % chunk).to_numpy()
        u, ties = merged(frame["side"].to_numpy(), group, frame["value"].to_numpy(), frame["c"].to_numpy(), chunk)
        return rows_of(key[0], key[1], u, ties, (u > 0) | (ties > 0))

    def across(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        side, group, c = frame["side"].to_numpy(), (frame["gid"] % chunk).to_numpy(), frame["c"].to_numpy().astype(float)
        _, place = np.unique(frame["block"].to_numpy(), return_inverse=True)
        a, b = (_dense(place[side == s], group[side == s], c[side == s], place.max() + 1, chunk) for s in (0, 1))
        u = a.T @ (np.cumsum(b, axis=0) - b)
        known = np.outer(np.isin(np.arange(chunk), group[side == 0]), np.isin(np.arange(chunk), group[side == 1]))
        return rows_of(key[0], key[1], u, np.zeros_like(u), known)

    local = _by_chunks(blocked, chunks, chunk).groupBy("p", "q", "block").applyInPandas(inside, _PAIRS)
    totals = blocked.groupBy("gid", "block").agg(F.sum("c").alias("c"))
    earlier = _by_chunks(totals, chunks, chunk).groupBy("p", "q").applyInPandas(across, _PAIRS)
    return local.union(earlier).groupBy("i", "j").agg(F.sum("u").alias("u"), F.sum("shared_ties").alias("shared_ties"))
