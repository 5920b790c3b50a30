"""Reading tables and preparing them at load time."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.summaries import summarise
from tidemark.functions.types import (
    datetime_columns,
    is_missing,
    numeric_columns,
    string_columns,
)

# Ranges of the integer types, smallest first.
_INTEGER_RANGES = [
    ("tinyint", -(2**7), 2**7 - 1),
    ("smallint", -(2**15), 2**15 - 1),
    ("int", -(2**31), 2**31 - 1),
]


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    row_limit: int | None = None,
    json_lines: bool | None = None,
    csv_sampling: float = 1.0,
    csv_multiline: bool = False,
) -> DataFrame:
    """Read a table by file suffix: ``.parquet``, ``.csv`` or ``.json``.

    CSV and JSON types are inferred unless a schema is given, and text columns in
    which every value is a date become timestamps.  JSON is one object per line
    unless the first character is ``[``; ``json_lines`` settles it beforehand.
    Quotes inside quoted CSV fields are doubled; fields with line breaks need
    ``csv_multiline``, which reads each file in one task.  A row limit applies
    before dates are looked for.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == "parquet":
        df = reader.parquet(path)
    elif suffix == "csv":
        df = reader.csv(
            path, header=True, inferSchema=schema is None, samplingRatio=csv_sampling, quote='"', escape='"',
            multiLine=csv_multiline,
        )
    elif suffix == "json":
        lines = not _starts_array(spark, path) if json_lines is None else json_lines
        df = reader.json(path, multiLine=not lines)
    else:
        raise ValueError(f"unsupported file format: .{suffix}")
    if row_limit is not None:
        df = df.limit(row_limit)
    return promote_dates(df) if schema is None and suffix != "parquet" else df


def _starts_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line with anything on it starts with ``[``."""
    line = spark.read.text(path).where("trim(value) != ''").first()
    return line is not None and line["value"].lstrip("\ufeff \t\r\n").startswith("[")


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType, csv_multiline: bool = False) -> DataFrame:
    """(rows, malformed, checksum) of a CSV file: malformed are rows that do not fit the schema."""
    mark = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(mark, T.StringType())])
    df = spark.read.schema(wide).csv(
        path, header=True, quote='"', escape='"', multiLine=csv_multiline, columnNameOfCorruptRecord=mark
    )
    # the marker cannot be read alone, so the other columns give a checksum
    others = F.xxhash64(*[F.col(f"`{f.name}`") for f in schema])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(mark).alias("malformed"), F.bit_xor(others).alias("checksum")
    )


def spread(df: DataFrame, parts: int = 32) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to more tasks.

    A file written as one row group is read by one task.  Large tables have more
    splits than ``parts`` and are returned unchanged; ``df`` must be a plain scan.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, parts)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """A seeded random sample (an opt-in operator; nothing else here samples).

    With ``keys``, which should identify a row, rows are chosen by the MD5 digest
    of seed and keys, so the choice does not depend on order or partitioning.
    """
    if not keys:
        return df.sample(fraction=fraction, seed=seed)
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys])
    number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(number < F.lit(int(fraction * (1 << 32))))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Write any result as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def date_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null text values that parse as a timestamp, per column."""
    return summarise(
        df,
        columns,
        lambda c: {
            "non_null": F.count(f"`{c}`"),
            "parsed": F.count(F.try_to_timestamp(F.col(f"`{c}`"))),
        },
    ).withColumn("share", F.col("parsed") / F.nullif(F.col("non_null"), F.lit(0)))


def promote_dates(df: DataFrame) -> DataFrame:
    """Turn text columns whose every value parses as a timestamp into timestamps."""
    texts = string_columns(df)
    if not texts:
        return df
    found = [r["column"] for r in date_shares(df, texts).where("share = 1").collect()]
    return df.withColumns({c: F.try_to_timestamp(F.col(f"`{c}`")) for c in found})


def clean_name(name: str) -> str:
    """Lower case, other characters to ``_``, runs of ``_`` collapsed, ends trimmed."""
    flat = "".join(ch if ch.isalnum() else "_" for ch in name.lower().strip())
    return re.sub("_+", "_", flat).strip("_")


def clean_column_names(df: DataFrame) -> DataFrame:
    names = [clean_name(c) for c in df.columns]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"cleaned column names collide: {repeated}")
    return df.toDF(*names)


def narrowing_plan(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """For every column: its type, the narrowest lossless type, and whether few
    distinct values make it a candidate for dictionary encoding."""
    distinct = F.approx_count_distinct if approximate_distinct else F.count_distinct
    no_number, no_count = F.lit(None).cast("double"), F.lit(None).cast("long")

    def stats(c: str) -> dict:
        col, dtype = F.col(f"`{c}`"), df.schema[c].dataType
        out = {
            "rows": F.count(F.lit(1)),
            "non_null": F.count(col),
            "low": F.max(no_count),
            "high": F.max(no_count),
            "exact": F.max(no_count),
            "integral": F.max(no_count),
            "distinct_values": F.max(no_count),
        }
        if isinstance(dtype, T.LongType):
            out |= {"low": F.min(col), "high": F.max(col)}
        elif isinstance(dtype, T.DoubleType):
            kept = F.isnan(col) | (col.cast("float").cast("double") == col)
            out |= {"exact": F.count_if(kept)}
        elif isinstance(dtype, T.StringType):
            out |= {
                "exact": F.count(col.try_cast("double")),
                "integral": F.count(F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), col.try_cast("long"))),
                "distinct_values": distinct(col),
            }
        return out

    types = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    low, high, exact, full = F.col("low"), F.col("high"), F.col("exact"), F.col("non_null")
    target = F.col("from_type")
    for name, lo, hi in reversed(_INTEGER_RANGES):
        target = F.when((F.col("from_type") == "bigint") & (low >= lo) & (high <= hi), name).otherwise(target)
    target = F.when((F.col("from_type") == "double") & (exact == full) & (full > 0), "float").otherwise(target)
    is_number = (F.col("from_type") == "string") & (full > 0) & (exact == full)
    target = (
        F.when(is_number & (F.col("integral") == full), "bigint").when(is_number, "double").otherwise(target)
    )
    candidate = ~is_number & (F.col("distinct_values") < F.col("rows") * 0.5)
    return (
        summarise(df, df.columns, stats)
        .withColumn("from_type", types[F.col("column")])
        .select(
            "column",
            "from_type",
            target.alias("to_type"),
            F.coalesce(candidate, F.lit(False)).alias("dictionary_candidate"),
        )
    )


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast each column to the narrowest type that keeps every value."""
    plan = {r["column"]: r for r in narrowing_plan(df, approximate_distinct=True).collect()}
    return df.select(
        *[
            F.col(f"`{c}`").cast(plan[c]["to_type"]).alias(c)
            if plan[c]["to_type"] != plan[c]["from_type"]
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def verify_integrity(df: DataFrame) -> DataFrame:
    """Load-time checks as (check, status, detail) rows."""
    cols = df.columns
    if not cols:
        return df.sparkSession.createDataFrame(
            [("has_columns", "error", "0")], "check string, status string, detail string"
        )
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    rows = F.col("rows")
    cells = rows * len(cols)
    missing = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    complete = F.round((F.lit(1.0) - missing / F.nullif(cells, F.lit(0))) * 100, 1)
    all_null = F.array_compact(
        F.array(*[F.when((rows > 0) & (F.col(f"m{i}") == rows), F.lit(c)) for i, c in enumerate(cols)])
    )

    def check(name: str, status, detail):
        return F.struct(
            F.lit(name).alias("check"), status.alias("status"), detail.cast("string").alias("detail")
        )

    ok = F.lit("success")
    checks = F.array(
        check("has_rows", F.when(rows == 0, "error").otherwise(ok), rows),
        check("has_columns", ok, F.lit(len(cols))),
        check("all_null_columns", F.when(F.size(all_null) > 0, "warning").otherwise(ok), F.array_join(all_null, ",")),
        check("completeness_percent", F.when(complete < 50, "warning").otherwise(ok), complete),
        check("numeric_columns", ok, F.lit(len(numeric_columns(df)))),
        check("categorical_columns", ok, F.lit(len(string_columns(df)))),
        check("datetime_columns", ok, F.lit(len(datetime_columns(df)))),
    )
    return one.select(F.inline(checks))


def verify_expectations(
    df: DataFrame,
    columns: Sequence[str] = (),
    maxima: Mapping[str, float] | None = None,
    max_distinct: Mapping[str, int] | None = None,
) -> DataFrame:
    """Domain checks: expected columns, largest allowed value, most distinct values."""
    maxima = {c: v for c, v in (maxima or {}).items() if c in df.columns}
    max_distinct = {c: v for c, v in (max_distinct or {}).items() if c in df.columns}
    absent = [c for c in columns if c not in df.columns]
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.max(f"`{c}`").cast("double").alias(f"max_{c}") for c in maxima],
        *[F.count_distinct(F.col(f"`{c}`")).alias(f"distinct_{c}") for c in max_distinct],
    )

    def check(name, subject, bad, value):
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(subject).alias("subject"),
            F.when(bad, "warning").otherwise("success").alias("status"),
            value.cast("double").alias("value"),
        )

    checks = [check("expected_columns", ",".join(absent), F.lit(bool(absent)), F.lit(len(absent)))]
    checks += [check("max_value", c, F.col(f"max_{c}") > v, F.col(f"max_{c}")) for c, v in maxima.items()]
    checks += [
        check("max_distinct", c, F.col(f"distinct_{c}") > v, F.col(f"distinct_{c}"))
        for c, v in max_distinct.items()
    ]
    return one.select(F.inline(F.array(*checks)))


def load(spark: SparkSession, path: str, narrow: bool = True, **options) -> DataFrame:
    """Read, verify, narrow types and clean names; an empty table raises."""
    df = read_table(spark, path, **options)
    failed = [r for r in verify_integrity(df).collect() if r["status"] == "error"]
    if failed:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in failed))
    return clean_column_names(narrow_types(df) if narrow else df)
