"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.shipping import ship_package
from tidemark.plans.storage import checkpoint_folder, freeze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Up to so many bytes a stored table is broadcast; beyond that its join shuffles.
BROADCAST_BYTES = 32 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers, and hand them texts in batches of a bounded number of rows.

    Rows are whole texts, so Spark's ten thousand to a batch would take a task much
    memory on both sides; a setting that the user has changed stays.
    """
    ship_package(spark)
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with SQL giving the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text of a row, null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: that of the checkpoints."""
    return checkpoint_folder(spark)


def broadcast_if_small(stored: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast when its rows, at most ``row_bytes`` wide, fit the bound."""
    return F.broadcast(stored) if stored.count() * row_bytes <= BROADCAST_BYTES else stored


def keep_rows(docs: DataFrame, column: str, ids: DataFrame, keep: bool) -> DataFrame:
    """Rows of ``docs`` whose ``column`` is (or is not) among ``ids.id``; null ids match nothing.

    ``ids`` is stored first: a small list is broadcast, a large one joins by a shuffle.
    """
    stored = ids.select(F.col("id").alias("__listed")).where("__listed is not null").distinct()
    listed = broadcast_if_small(freeze(stored), 16)
    return docs.join(listed, docs[column] == listed["__listed"], "left_semi" if keep else "left_anti")


__all__ = [
    "BROADCAST_BYTES",
    "ORACLES",
    "QUERIES",
    "broadcast_if_small",
    "freeze",
    "keep_rows",
    "prepare",
    "query",
    "shared_folder",
    "shuffle_parts",
    "table",
    "whole_text",
]
