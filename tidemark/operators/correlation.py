"""Correlation of numeric columns and association between column pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.special import chi2_sf, normal_quantile, t_sf2
from tidemark.functions.types import as_double, is_missing, numeric_columns, require_columns, string_columns
from tidemark.plans.joining import attach
from tidemark.plans.ordered import prefix_sums
from tidemark.plans.quantiles import melt, value_counts
from tidemark.plans.storage import freeze

MIN_SIGNIFICANCE = 0.05


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    found = list(combinations(columns, 2))
    if not found:
        raise ValueError("need at least two columns")
    return found


def pair_correlation(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates (pair count, Pearson r) over rows where both values are present."""
    both = x.isNotNull() & y.isNotNull()
    return F.count_if(both), F.corr(F.when(both, x), F.when(both, y))


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pair count and Pearson r of every column pair, in one pass."""
    columns = numeric_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    pairs = _pairs(columns)
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        n, r = pair_correlation(as_double(df, a), as_double(df, b))
        aggregates += [n.alias(f"n{i}"), r.alias(f"r{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("column1"),
                F.lit(b).alias("column2"),
                F.col(f"n{i}").alias("sample_size"),
                F.nanvl(F.col(f"r{i}"), F.lit(None).cast("double")).alias("correlation"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def strength(r: Column, lowest: str = "very_weak") -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.9, "very_strong")
        .when(size >= 0.7, "strong")
        .when(size >= 0.5, "moderate")
        .when(size >= 0.3, "weak")
        .otherwise(lowest)
    )


def fisher_interval(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Confidence interval of Pearson r through Fisher's transformation."""
    usable = (n > 3) & (F.abs(r) < 1)
    centre = F.when(usable, F.atanh(r))
    reach = z / F.sqrt(F.when(usable, n - 3))
    return F.tanh(centre - reach), F.tanh(centre + reach)


def correlation_interval(r: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Fisher interval with the exact normal quantile of ``confidence``."""
    return fisher_interval(r, n, normal_quantile(1 - (1 - confidence) / 2))


def approximate_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """Analytic margin 1.96·1.2/√(n-3) used for rank correlations; r itself up to n = 10."""
    reach = F.when(n > 10, 1.96 * 1.2 / F.sqrt(n - 3)).otherwise(0.0)
    return F.greatest(F.lit(-1.0), r - reach), F.least(F.lit(1.0), r + reach)


def _describe_pairs(found: DataFrame, method: str, p_value: Column, interval: tuple[Column, Column]) -> DataFrame:
    r = F.col("correlation")
    return (
        found.where((F.col("sample_size") >= 3) & r.isNotNull())
        .withColumn("p_value", p_value)
        .select(
            "column1",
            "column2",
            "correlation",
            F.abs(r).alias("abs_correlation"),
            "p_value",
            (F.col("p_value") < MIN_SIGNIFICANCE).alias("significant"),
            strength(r).alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
            "sample_size",
            interval[0].alias("ci_lower"),
            interval[1].alias("ci_upper"),
            F.lit(method).alias("method"),
        )
    )


def _correlation_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    exact = F.abs(r) >= 1
    return F.when(exact, 0.0).when(n > 2, t_sf2(t, F.when(n > 2, n - 2)))


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    r, n = F.col("correlation"), F.col("sample_size")
    return _describe_pairs(pearson_pairs(df, columns), "pearson", _correlation_p(r, n), fisher_interval(r, n))


def _paired_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (pair, x, y) with their count and the centred average ranks of x and y.

    Equal rows are merged first; ranks come from running counts of the distinct
    values of each side, so no task holds a whole column.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"), (as_double(df, a) + 0).alias("x"), (as_double(df, b) + 0).alias("y")
            )
            for i, (a, b) in enumerate(_pairs(columns))
        ]
    )
    merged = freeze(
        df.select(F.inline(rows))
        .where("x is not null and y is not null")
        .groupBy("pair", "x", "y")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    for side in ("x", "y"):
        per_value = merged.groupBy("pair", side).agg(F.sum("c").alias("c"))
        merged = attach(merged, _centred_ranks(per_value, "pair", side, f"u_{side}"), ["pair", side])
    return merged


def _centred_ranks(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Average rank of each distinct value less the mean rank, per key.

    Centring by the known mean (n + 1) / 2 keeps the later sums small.
    """
    ranked = prefix_sums(counts, [key], [value], {"__before": "c"}, {"__n": "c"})
    rank = F.col("__before") + (F.col("c") + 1) / 2 - (F.col("__n") + 1) / 2
    return ranked.select(key, value, rank.alias(out))


def _rank_sums_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank products per pair when no value is missing: each column is ranked once."""
    counts = freeze(value_counts(melt(df, columns), ["column"]))
    ranked = freeze(_centred_ranks(counts, "column", "value", "u"))
    wide = df.select(*[(as_double(df, c) + 0).alias(f"v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        one = ranked.where(F.col("column") == c).select(F.col("value").alias(f"v{i}"), F.col("u").alias(f"u{i}"))
        wide = attach(wide, one, [f"v{i}"], stored=True).drop(f"v{i}")
    place = {c: i for i, c in enumerate(columns)}
    pairs = [(place[a], place[b]) for a, b in _pairs(columns)]
    product = lambda i, j: F.col(f"u{i}") * F.col(f"u{j}")
    one = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(product(i, i)).alias(f"s{i}") for i in range(len(columns))],
        *[F.sum(product(i, j)).alias(f"p{k}") for k, (i, j) in enumerate(pairs)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("pair"), F.col("n").alias("sample_size"), F.col(f"p{k}").alias("uv"),
                F.col(f"s{i}").alias("uu"), F.col(f"s{j}").alias("vv"),
            )
            for k, (i, j) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(rows))


def _rank_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank products per pair, each pair ranked over its own complete rows."""
    c, u, v = F.col("c"), F.col("u_x"), F.col("u_y")
    return _paired_ranks(df, columns).groupBy("pair").agg(
        F.sum("c").alias("sample_size"), F.sum(c * u * v).alias("uv"), F.sum(c * u * u).alias("uu"),
        F.sum(c * v * v).alias("vv"),
    )


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman's rho: Pearson r of average ranks."""
    columns = numeric_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    pairs = _pairs(columns)
    gaps = df.agg(*[F.bool_or(is_missing(df, c)).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    sums = _rank_sums(df, columns) if any(gaps) else _rank_sums_complete(df, columns)
    names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])[F.col("pair")]
    found = sums.select(
        names[0].alias("column1"),
        names[1].alias("column2"),
        "sample_size",
        (F.col("uv") / F.nullif(F.sqrt(F.col("uu") * F.col("vv")), F.lit(0.0))).alias("correlation"),
    )
    r, n = F.col("correlation"), F.col("sample_size")
    return _describe_pairs(found, "spearman", _correlation_p(r, n), approximate_interval(r, n))


def cramers_v_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Chi-square test of independence and Cramér's V for every pair of text columns.

    Pairs need ten complete rows and two levels each; 2x2 tables use Yates'
    correction.
    """
    columns = string_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    pairs = _pairs(columns)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = (
        df.select(F.inline(rows))
        .where("a is not null and b is not null")
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    side_a = cells.groupBy("pair", "a").agg(F.sum("o").alias("na"))
    side_b = cells.groupBy("pair", "b").agg(F.sum("o").alias("nb"))
    shape = (
        side_a.groupBy("pair")
        .agg(F.count(F.lit(1)).alias("levels_a"), F.sum("na").alias("n"))
        .join(side_b.groupBy("pair").agg(F.count(F.lit(1)).alias("levels_b")), "pair")
        .where("levels_a > 1 and levels_b > 1 and n >= 10")
    )
    # Cells with no rows add their expected count to the statistic; all expected
    # counts add up to n, so they follow from the cells seen.
    full = attach(attach(attach(cells, side_a, ["pair", "a"]), side_b, ["pair", "b"]), shape, ["pair"])
    expected = F.col("na").cast("double") * F.col("nb") / F.col("n")
    yates = (F.col("levels_a") == 2) & (F.col("levels_b") == 2)
    gap = F.abs(F.col("o") - expected)
    shrunk = F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    stats = (
        full.groupBy("pair", "levels_a", "levels_b", "n")
        .agg(
            F.sum(shrunk * shrunk / expected).alias("seen"),
            F.sum(expected).alias("seen_expected"),
            F.count(F.lit(1)).alias("cells_seen"),
        )
        .withColumn("dof", (F.col("levels_a") - 1) * (F.col("levels_b") - 1))
    )
    unseen = F.greatest(F.col("n") - F.col("seen_expected"), F.lit(0.0))
    some_unseen = F.col("cells_seen") < F.col("levels_a") * F.col("levels_b")
    # The empty cells of a 2x2 table (one, or two on a diagonal) share one expected count.
    empty = F.nullif(4 - F.col("cells_seen"), F.lit(0))
    each = unseen / empty
    corrected = each - F.least(F.lit(0.5), each)
    unseen_part = F.when(
        F.col("dof") == 1, empty * corrected * corrected / F.nullif(each, F.lit(0.0))
    ).otherwise(unseen)
    chi2 = F.col("seen") + F.when(some_unseen, F.coalesce(unseen_part, F.lit(0.0))).otherwise(0.0)
    names = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])[F.col("pair")]
    smaller = F.least("levels_a", "levels_b") - 1
    return (
        stats.withColumn("chi2_statistic", chi2)
        .withColumn("p_value", chi2_sf(F.col("chi2_statistic"), F.col("dof")))
        .select(
            names[0].alias("column1"),
            names[1].alias("column2"),
            "chi2_statistic",
            "p_value",
            F.col("dof").alias("degrees_of_freedom"),
            F.sqrt(F.col("chi2_statistic") / F.col("n") / smaller).alias("cramers_v"),
            (F.col("p_value") < MIN_SIGNIFICANCE).alias("significant"),
            F.col("n").alias("sample_size"),
        )
    )
