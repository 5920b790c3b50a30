"""Column groups by type, and null-safe numeric views of columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATETIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DATETIMES)]


def is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column: both count as missing."""
    col = F.col(f"`{column}`")
    return col.isNull() | F.isnan(col) if is_float(df, column) else col.isNull()


def as_double(df: DataFrame, column: str) -> Column:
    """The column as double with NaN turned into null."""
    col = F.col(f"`{column}`").cast("double")
    return F.nanvl(col, F.lit(None).cast("double")) if is_float(df, column) else col


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")


def type_group(df: DataFrame, column: str) -> str:
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, _DATETIMES):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"
