"""Data-quality scores, issues and recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import percent
from tidemark.functions.summaries import summarise
from tidemark.functions.types import (
    as_double,
    datetime_columns,
    is_missing,
    numeric_columns,
    string_columns,
)
from tidemark.operators.aggregate import duplicate_rows
from tidemark.operators.correlation import pearson_pairs
from tidemark.operators.describe import missing_by_column
from tidemark.operators.frequencies import short_key
from tidemark.operators.profile import column_profile, fence_counts
from tidemark.plans.joining import null_safe_join
from tidemark.plans.quantiles import SMALL_VALUES, quantiles
from tidemark.plans.storage import freeze

# Name parts, placeholders, and marks of date-like text.
ID_WORDS = ["id", "key", "index", "uuid"]
AGE_WORDS = ["age", "years_old"]
PAST_WORDS = ["created", "born"]
PLACEHOLDERS = ["unknown", "null", "n/a", "na", "none", "", "missing"]
DATE_MARKS = ["-", "/", ":", "T", "20", "19"]
NUMBER_PATTERN = r"^-?\d+\.?\d*$"

# Score lost per finding.
PENALTIES = {"consistency": 10, "validity": 15, "duplicate_column": 10, "accuracy": 20, "issue": 2}

_FINDING = "aspect string, type string, column string, count long, percentage double"


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], _FINDING)


def _finding(rows: DataFrame, aspect: str, kind: str, count: Column, pct: Column | None = None) -> DataFrame:
    pct = F.lit(None).cast("double") if pct is None else F.round(pct, 2)
    return rows.select(
        F.lit(aspect).alias("aspect"),
        F.lit(kind).alias("type"),
        "column",
        count.cast("long").alias("count"),
        pct.alias("percentage"),
    )


def column_quality(df: DataFrame) -> DataFrame:
    """Missing share, quality score (100 - missing %), type and distinct values per column."""
    return column_profile(df).select(
        "column",
        F.round("null_percentage", 2).alias("missing_percentage"),
        F.round(100 - F.col("null_percentage"), 2).alias("quality_score"),
        F.col("dtype").alias("data_type"),
        F.col("unique_count").alias("unique_values"),
        "null_count",
    )


def completeness(df: DataFrame) -> DataFrame:
    """Completeness score, missing cells, columns with missing and mostly missing columns."""
    m, pct = F.col("missing"), F.col("missing_pct")
    rows = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("__k", F.lit(1))
    cells = F.col("rows") * len(df.columns)
    return (
        missing_by_column(df)
        .agg(
            F.sum("missing").alias("total_missing_cells"),
            F.count_if(m > 0).alias("columns_with_missing"),
            F.count_if(F.round(pct, 2) > 80).alias("columns_mostly_missing"),
        )
        .withColumn("__k", F.lit(1))
        .join(rows, "__k")
        .select(
            F.round(percent(cells - F.col("total_missing_cells"), cells), 2).alias("completeness_score"),
            "total_missing_cells",
            F.round(percent(F.col("total_missing_cells"), cells), 2).alias("missing_percentage"),
            "columns_with_missing",
            "columns_mostly_missing",
        )
    )


def date_format(value: Column) -> Column:
    """Class of a date-like text by its separators, null if none applies."""
    text = F.trim(value)
    parts = lambda sep: F.size(F.split(text, sep, -1))
    return (
        F.when(parts("/") == 3, "MM/DD/YYYY or DD/MM/YYYY")
        .when(parts("-") == 3, "YYYY-MM-DD")
        .when(F.contains(text, F.lit("T")), "ISO datetime")
        .when(F.contains(text, F.lit(":")), "HH:MM:SS")
    )


def consistency_findings(df: DataFrame) -> DataFrame:
    """Mixed numbers and text, several date formats, and values differing only in case.

    All rows are read.  A column counts as date-like when more than half of its
    values hold one of the date marks.
    """
    texts = string_columns(df)
    if not texts:
        return _none(df)
    marks = [F.lit(m) for m in DATE_MARKS]

    def stats(c: str) -> dict[str, Column]:
        col = F.col(f"`{c}`")
        marked = reduce(lambda a, b: a | b, [F.contains(col, m) for m in marks])
        return {
            "n": F.count(col),
            "numeric": F.count_if(col.rlike(NUMBER_PATTERN)),
            "marked": F.count_if(marked),
            "formats": F.size(F.collect_set(date_format(col))),
        }

    seen = summarise(df, texts, stats)
    mixed = _finding(
        seen.where("numeric > 0 and numeric < n"), "consistency", "mixed_types", F.col("numeric"),
        percent(F.col("numeric"), F.col("n")),
    )
    dates = _finding(
        seen.where("marked > n * 0.5 and formats > 1"), "consistency", "inconsistent_date_formats", F.col("formats")
    )
    keys = case_variants(df)
    cases = _finding(
        keys.where("inconsistent > 0 and inconsistent < keys * 0.5"),
        "consistency",
        "case_inconsistency",
        F.col("inconsistent"),
    )
    return mixed.union(dates).union(cases)


def case_variants(df: DataFrame) -> DataFrame:
    """Per text column: lower-cased values, and how many of them are spelled in several ways.

    Two spellings exist exactly if the smallest and largest differ, so no set of
    spellings is kept.  Long texts take part by their digests.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), short_key(F.lower(f"`{c}`")).alias("k"), short_key(F.col(f"`{c}`")).alias("value")
            )
            for c in string_columns(df)
        ]
    )
    spelled = df.select(F.inline(pairs)).where("value is not null")
    per_key = spelled.groupBy("column", "k").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return per_key.groupBy("column").agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("lo") != F.col("hi")).alias("inconsistent")
    )


def validity_findings(df: DataFrame, small_values: int = SMALL_VALUES) -> DataFrame:
    """Values beyond 3·IQR, impossible ages, and future dates in columns about the past."""
    out = _none(df)
    numbers = numeric_columns(df)
    if numbers:
        q = quantiles(df, numbers, {"q1": 0.25, "q3": 0.75}, small_values=small_values)
        counts = fence_counts(df, numbers, q, 3.0)
        n = summarise(df, numbers, lambda c: {"n": F.count(as_double(df, c))})
        extreme = null_safe_join(counts, n, ["column"]).where("outlier_count > 0")
        out = out.union(
            _finding(extreme, "validity", "extreme_outliers", F.col("outlier_count"),
                     percent(F.col("outlier_count"), F.col("n")))
        )
    ages = [c for c in numbers if any(w in c.lower() for w in AGE_WORDS)]
    if ages:
        bad = summarise(df, ages, lambda c: {"bad": F.count_if((as_double(df, c) < 0) | (as_double(df, c) > 150))})
        out = out.union(_finding(bad.where("bad > 0"), "validity", "invalid_range", F.col("bad")))
    past = [c for c in datetime_columns(df) if any(w in c.lower() for w in PAST_WORDS)]
    if past:
        now = F.current_timestamp()
        ahead = summarise(df, past, lambda c: {"bad": F.count_if(F.col(f"`{c}`").cast("timestamp") > now)})
        out = out.union(_finding(ahead.where("bad > 0"), "validity", "future_dates", F.col("bad")))
    return out


def identical_columns(df: DataFrame) -> DataFrame:
    """Column pairs of one type that agree, nulls included, in every row."""
    fields = df.schema.fields
    pairs = [
        (a.name, b.name) for i, a in enumerate(fields) for b in fields[i + 1 :] if a.dataType == b.dataType
    ]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column1 string, column2 string")
    one = df.agg(
        *[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(f"p{i}").alias("same"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(rows)).where("same").select("column1", "column2")


def uniqueness_findings(df: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Duplicate rows, identical columns and identifier columns with repeats.

    ``duplicates`` is the result of ``duplicate_rows``, where it is known already.
    """
    duplicates = duplicate_rows(df) if duplicates is None else duplicates
    rows = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("__k", F.lit(1))
    dup = duplicates.withColumn("__k", F.lit(1)).join(rows, "__k").withColumn("column", F.lit(None).cast("string"))
    out = _finding(
        dup.where("duplicate_rows > 0"), "uniqueness", "duplicate_rows", F.col("duplicate_rows"),
        percent(F.col("duplicate_rows"), F.col("rows")),
    )
    same = identical_columns(df).withColumn("column", F.concat_ws(",", "column1", "column2"))
    out = out.union(_finding(same, "uniqueness", "duplicate_columns", F.lit(2)))
    ids = [c for c in df.columns if any(w in c.lower() for w in ID_WORDS)]
    if ids:
        found = summarise(
            df, ids, lambda c: {"n": F.count_if(~is_missing(df, c)), "d": F.count_distinct(F.col(f"`{c}`"))}
        )
        out = out.union(_finding(found.where("d < n"), "uniqueness", "non_unique_id", F.col("n") - F.col("d")))
    return out


def accuracy_findings(df: DataFrame) -> DataFrame:
    """More than 10 % placeholder texts; near-perfect correlations, which count as one finding."""
    out = _none(df)
    texts = string_columns(df)
    if texts:
        found = summarise(
            df,
            texts,
            lambda c: {"n": F.count(f"`{c}`"), "hits": F.count_if(F.lower(f"`{c}`").isin(PLACEHOLDERS))},
        )
        out = out.union(
            _finding(found.where("hits > n * 0.1"), "accuracy", "placeholder_values", F.col("hits"),
                     percent(F.col("hits"), F.col("n")))
        )
    if len(numeric_columns(df)) > 1:
        close = pearson_pairs(df).where(F.abs("correlation") > 0.99)
        listed = close.agg(
            F.count(F.lit(1)).alias("pairs"),
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws("~", "column1", "column2"))), ","
            ).alias("column"),
        ).where("pairs > 0")
        out = out.union(_finding(listed, "accuracy", "perfect_correlations", F.col("pairs")))
    return out


def issues(df: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Priority issues: mostly missing, 5-90 % missing, all rows duplicated, constant columns."""
    duplicates = duplicate_rows(df) if duplicates is None else duplicates
    # Equal extremes mean at most one distinct value, without a distinct count.
    profile = freeze(
        summarise(
            df,
            df.columns,
            lambda c: {
                "pct": percent(F.count_if(is_missing(df, c)), F.count(F.lit(1))),
                "constant": F.min(F.col(f"`{c}`")).eqNullSafe(F.max(F.col(f"`{c}`"))),
            },
        )
    )
    pct = F.col("pct")
    mostly = profile.where(pct > 90).select(
        F.lit("critical").alias("severity"), F.lit("mostly_missing").alias("type"), "column"
    )
    some = profile.where((pct >= 5) & (pct <= 90)).select(F.lit("high"), F.lit("high_missing_values"), "column")
    constant = profile.where("constant").select(F.lit("high"), F.lit("constant_column"), "column")
    # Every row repeats an earlier one only in a table without rows, so the check
    # asks whether one distinct row fills the table.
    rows = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("__k", F.lit(1))
    repeated = (
        duplicates
        .withColumn("__k", F.lit(1))
        .join(rows, "__k")
        .where("rows > 1 and duplicate_rows = rows - 1")
        .select(F.lit("critical"), F.lit("all_duplicates"), F.lit(None).cast("string"))
    )
    return mostly.union(some).union(repeated).union(constant)


def findings(
    df: DataFrame, small_values: int = SMALL_VALUES, duplicates: DataFrame | None = None
) -> DataFrame:
    """Every finding of the four aspects."""
    return (
        consistency_findings(df)
        .union(validity_findings(df, small_values))
        .union(uniqueness_findings(df, duplicates))
        .union(accuracy_findings(df))
    )


def quality_scores(df: DataFrame, small_values: int = SMALL_VALUES) -> DataFrame:
    """Five aspect scores and the overall score, one row.

    Each score starts at 100 and loses points per finding; uniqueness also loses
    the share of duplicate rows.  Overall is their mean less two per issue.
    """
    duplicates = freeze(duplicate_rows(df))
    counted = findings(df, small_values, duplicates).agg(
        *[
            F.count_if(F.col("aspect") == a).alias(a) for a in ("consistency", "validity", "accuracy")
        ],
        F.count_if(F.col("type") == "duplicate_columns").alias("same_columns"),
        F.coalesce(F.max(F.when(F.col("type") == "duplicate_rows", F.col("percentage"))), F.lit(0.0)).alias("dup_pct"),
    )
    issue_count = issues(df, duplicates).agg(F.count(F.lit(1)).alias("issues"))
    floor = lambda lost: F.greatest(F.lit(0.0), F.lit(100.0) - lost)
    scored = (
        completeness(df)
        .withColumn("__k", F.lit(1))
        .join(counted.withColumn("__k", F.lit(1)), "__k")
        .join(issue_count.withColumn("__k", F.lit(1)), "__k")
        .select(
            "completeness_score",
            floor(F.col("consistency") * PENALTIES["consistency"]).alias("consistency_score"),
            floor(F.col("validity") * PENALTIES["validity"]).alias("validity_score"),
            floor(F.col("dup_pct") + F.col("same_columns") * PENALTIES["duplicate_column"]).alias("uniqueness_score"),
            floor(F.col("accuracy") * PENALTIES["accuracy"]).alias("accuracy_score"),
            "issues",
        )
    )
    aspects = ["completeness", "consistency", "validity", "uniqueness", "accuracy"]
    mean = sum((F.col(f"{a}_score") for a in aspects), F.lit(0.0)) / len(aspects)
    overall = F.round(F.greatest(F.lit(0.0), mean - F.col("issues") * PENALTIES["issue"]), 2)
    return scored.withColumn("overall_score", overall)


def recommendations(df: DataFrame) -> DataFrame:
    """What to do about the findings, one row per advice."""
    text = "recommendation"
    complete = completeness(df)
    impute = complete.where("completeness_score < 80").select(
        F.lit("Impute or remove missing values").alias(text), F.lit(None).cast("string").alias("column")
    )
    sparse = (
        column_profile(df, approximate_distinct=True)
        .where(F.round("null_percentage", 2) > 80)
        .select(F.lit("Drop this column: over 80% is missing"), "column")
    )
    unique = uniqueness_findings(df)
    rows = unique.where("type = 'duplicate_rows'").select(
        F.format_string("Remove %d duplicate rows", "count"), F.lit(None).cast("string")
    )
    cols = unique.where("type = 'duplicate_columns'").select(F.lit("Drop one of two identical columns"), "column")
    mixed = consistency_findings(df).limit(1).select(
        F.lit("Resolve inconsistent values before analysis"), F.lit(None).cast("string")
    )
    critical = issues(df).where("severity = 'critical' and column is not null").select(
        F.lit("Remove or impute this column"), "column"
    )
    return impute.union(sparse).union(rows).union(cols).union(mixed).union(critical)
