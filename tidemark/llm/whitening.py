"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Entries become integers, so that equal vectors, sums and deviations are exact.  The
distinct vectors are the fit list.  Each task reduces its centred rows to one triangular
factor, factors meet in a tree of ``FAN_IN`` a step, and the last one, as large as the
square of the dimension whatever the number of rows, is solved on the driver.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
left out; repeated rows count once in the fit and come back as often as they are given;
vectors of another length are a fit of their own; components without spread have no rows,
so a single distinct vector gives none; entries beyond 2^56 count as 2^56; a deviation that
no long holds is null; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bidiagonal import directions
from tidemark.llm.common import freeze, prepare, query, table

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
FAR = 2.0**62
FAN_IN = 32
BLOCK_ROWS = 4096
LOW_BITS = 31
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def to_integers(entries: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * entries), -FAR, FAR).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return to_integers(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dims)


@dataclass
class Fit:
    """``n`` distinct vectors with sums ``sums``; unit directions as columns, their eigenvalues, the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: in machine integers where they hold it, else in Python's."""
        reach = max([abs(int(x.min())), abs(int(x.max()))]) if x.size else 0
        if self.n * reach + max(map(abs, self.sums)) < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x).astype(float) / self.n) @ self.axes / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        gaps = self.scaled(x)
        if gaps.dtype == object or (gaps.size and float(np.abs(gaps).max()) ** 2 * gaps.shape[1] > 2.0**62):
            exact = [sum(int(g) ** 2 for g in row) for row in gaps]
            return [d if d < 1 << 63 else None for d in exact]
        return (gaps * gaps).sum(axis=1).tolist()


def distinct_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """(x): each integer vector once, packed; equal rows of a task merge before the shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for row in _matrix(batch.column(0), dims)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["x"])

    return rows.select("entries").mapInArrow(pack, "x binary").distinct()


def vector_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, S): the sums are kept in two halves, so no number of rows overflows them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0), dims)
            n += len(x)
            high += (x >> LOW_BITS).sum(axis=0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        arrays = [pa.array(np.arange(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", "n", "high", "low"])

    parts = vectors.mapInArrow(add, "at int, n long, high long, low long").groupBy("at")
    found = parts.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("at").collect()
    return (found[0]["n"] if found else 0), [(r["high"] << LOW_BITS) + r["low"] for r in found]


def triangular_factor(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR of all centred rows: one factor a task, then a tree of factors."""
    dims = len(sums)
    centre = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)

    def factor_row(place: int, factor: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array([place], pa.int64()), pa.array([factor.astype("<f8").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["place", "factor"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dims))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = _vectors(batch.column(0).slice(at, BLOCK_ROWS), dims)
                centred = centre.scaled(x).astype(float) / n
                factor = np.linalg.qr(np.vstack([factor, centred]), mode="r")
        yield factor_row(TaskContext.get().partitionId(), factor)

    def merge(part: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(f, dtype="<f8").reshape(-1, dims) for f in part.column("factor").to_pylist()]
        factor = np.linalg.qr(np.vstack(blocks), mode="r")
        return pa.Table.from_batches([factor_row(part.column("place")[0].as_py(), factor)])

    factors = freeze(vectors.mapInArrow(reduce, "place long, factor binary"))
    places = (factors.agg(F.max("place")).first()[0] or 0) + 1
    while places > 1:
        grouped = factors.withColumn("place", F.floor(F.col("place") / FAN_IN)).groupBy("place")
        factors = freeze(grouped.applyInArrow(merge, "place long, factor binary"))
        places = -(-places // FAN_IN)
    last = factors.first()
    found = np.frombuffer(last["factor"], dtype="<f8").reshape(-1, dims) if last else np.zeros((0, dims))
    return np.vstack([found, np.zeros((dims - len(found), dims))])


def fit_whitening(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Fit:
    n, sums = vector_sums(vectors, dims)
    values, axes = directions(triangular_factor(vectors, n, sums), components)
    spread = values * values / n
    return Fit(n, sums, axes, spread[: axes.shape[1]], float(spread.sum()))


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity."""
    dims, k = len(fit.sums), fit.axes.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                y = fit.whiten(_vectors(batch.column(0).slice(at, BLOCK_ROWS), dims))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    cells = vectors.mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    covariance = np.array([c["v"] for c in cells]).reshape(k, k) / fit.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(
    table_: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row for each vector and component, by falling eigenvalue from 1 on."""
    prepare(table_.sparkSession)
    entries = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table_.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), entries.alias("entries"))
    infinite = float("inf")
    good = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (c != infinite) & (c != -infinite))
    rows = rows.where(F.col("entries").isNotNull() & (F.size("entries") > 0) & good)
    out = table_.sparkSession.createDataFrame([], COLUMNS)
    lengths = [r["d"] for r in rows.select(F.size("entries").alias("d")).distinct().orderBy("d").collect()]
    for dims in lengths:
        out = out.union(_whiten_length(rows.where(F.size("entries") == dims), dims, components))
    return out


def _whiten_length(rows: DataFrame, dims: int, components: int) -> DataFrame:
    vectors = freeze(distinct_vectors(rows, dims))
    fit = fit_whitening(vectors, dims, components)
    error = identity_error(vectors, fit)
    k = fit.axes.shape[1]
    explained = fit.eigenvalues / fit.trace if k else fit.eigenvalues

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            if not k or not len(x):
                continue
            again = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(again), fit.n)),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(again)),
                    pa.array(fit.whiten(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(again), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, COLUMNS)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, folder):
    return whiten(table(spark, folder, "embeddings"))
