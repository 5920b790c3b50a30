"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.shipping import ship_package
from tidemark.sources.readers import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with SQL giving the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spread(read_table(spark, f"{folder}/{name}.parquet"))


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round floating columns so two engines' sums compare equal."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def union_all(template: str, values) -> str:
    """One SELECT per value of ``{c}``, joined by UNION ALL."""
    return "\nUNION ALL\n".join(template.replace("{c}", v) for v in values)
