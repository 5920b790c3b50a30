"""Association between columns: rules on value pairs and the combined correlation report."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import numeric_columns, require_columns, string_columns
from tidemark.operators import correlation as corr
from tidemark.operators.hypothesis import ALPHA, anova_of, benjamini_hochberg, grouped_values
from tidemark.operators.kendall import kendall
from tidemark.plans.joining import attach


def association_rules(
    df: DataFrame, columns: Sequence[str] | None = None, min_support: float = 0.1
) -> DataFrame:
    """Rules ``column1 = value1 → column2 = value2`` with support, confidence and lift.

    Support and lift are shares of all rows, rows with nulls included.
    """
    columns = string_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    if len(columns) < 2:
        raise ValueError("need at least two columns")
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    pairs = list(combinations(range(len(columns)), 2))
    values = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"),
                F.lit(b).alias("b"),
                F.col(f"`{columns[a]}`").alias("value1"),
                F.col(f"`{columns[b]}`").alias("value2"),
            )
            for a, b in pairs
        ]
    )
    found = (
        df.select(F.inline(values))
        .where("value1 is not null and value2 is not null")
        .groupBy("a", "b", "value1", "value2")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") >= F.lit(min_support) * total)
    )
    singles = F.array(
        *[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(columns)]
    )
    # Only values frequent enough to be part of a rule: at most 1 / min_support per column.
    margins = (
        df.select(F.inline(singles))
        .where("v is not null")
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.lit(min_support) * total)
    )
    left = margins.select(F.col("i").alias("a"), F.col("v").alias("value1"), F.col("n").alias("n1"))
    right = margins.select(F.col("i").alias("b"), F.col("v").alias("value2"), F.col("n").alias("n2"))
    names = F.array(*[F.lit(c) for c in columns])
    return attach(attach(found, left, ["a", "value1"]), right, ["b", "value2"]).select(
        names[F.col("a")].alias("column1"),
        "value1",
        names[F.col("b")].alias("column2"),
        "value2",
        "count",
        (F.col("count") / F.lit(float(total))).alias("support"),
        (F.col("count") / F.col("n1")).alias("confidence"),
        (F.col("count").cast("double") * total / (F.col("n1").cast("double") * F.col("n2"))).alias("lift"),
    )


def best_associations(
    df: DataFrame, columns: Sequence[str] | None = None, min_support: float = 0.1, top: int = 20
) -> DataFrame:
    """The rule of highest lift of every column pair (tie: smallest values), strongest first."""
    rules = association_rules(df, columns, min_support)
    rest = [c for c in rules.columns if c not in ("column1", "column2")]
    order = F.struct(-F.col("lift"), F.col("value1"), F.col("value2"))
    best = rules.groupBy("column1", "column2").agg(F.min_by(F.struct(*rest), order).alias("best"))
    return (
        best.select("column1", "column2", "best.*").orderBy(F.desc("lift"), "column1", "column2").limit(top)
    )


def anova_pairs(df: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One-way ANOVA of each number over each category."""
    out = None
    for c in categories:
        tested = anova_of(grouped_values(df, c, numbers)).withColumn("category", F.lit(c))
        out = tested if out is None else out.union(tested)
    if out is None:
        raise ValueError("no category columns")
    return out


def association_report(
    df: DataFrame,
    method: str = "pearson",
    min_correlation: float = 0.0,
    numbers: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
) -> DataFrame:
    """Every column pair in one table: correlation, chi-square or ANOVA, BH-corrected.

    All rows and columns are used; ``min_correlation`` drops weaker numeric pairs.
    """
    numbers = numeric_columns(df) if numbers is None else list(numbers)
    categories = string_columns(df) if categories is None else list(categories)
    parts = []
    if len(numbers) > 1:
        by_method = {"pearson": corr.pearson, "spearman": corr.spearman, "kendall": kendall}
        found = by_method[method](df, numbers).where(F.col("abs_correlation") >= min_correlation)
        parts.append(
            found.select(
                F.lit(method).alias("test"), "column1", "column2", F.col("correlation").alias("statistic"), "p_value",
                F.col("abs_correlation").alias("effect"), (F.col("abs_correlation") > 0.7).alias("large"),
            )
        )
    if len(categories) > 1:
        parts.append(
            corr.cramers_v_pairs(df, categories).select(
                F.lit("chi_square").alias("test"), "column1", "column2", F.col("chi2_statistic").alias("statistic"),
                "p_value", F.col("cramers_v").alias("effect"), (F.col("cramers_v") > 0.5).alias("large"),
            )
        )
    if numbers and categories:
        parts.append(
            anova_pairs(df, numbers, categories).where(F.col("p_value") < ALPHA).select(
                F.lit("anova").alias("test"), F.col("column").alias("column1"), F.col("category").alias("column2"),
                "statistic", "p_value", F.col("eta_squared").alias("effect"), F.lit(False).alias("large"),
            )
        )
    if not parts:
        raise ValueError("need two columns to compare")
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    significant = F.col("p_value") < ALPHA
    return (
        benjamini_hochberg(union)
        .withColumn("significant", significant)
        .withColumn("strong", significant & F.col("large"))
        .select("test", "column1", "column2", "statistic", "p_value", "p_value_corrected", "effect", "significant",
                "significant_corrected", "strong")
    )
