"""Hypothesis tests: grouped sums, ranks and medians on Spark, p-values on the result rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normality import log_normal_tails, shapiro_wilk
from tidemark.functions.special import chi2_sf, f_sf, normal_tail, t_ppf, t_sf2
from tidemark.functions.types import as_double, require_columns
from tidemark.operators.pairwise_ranks import pair_sums
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.ordered import blocks_in_order, minimum_from_here, prefix_sums, with_position
from tidemark.plans.quantiles import SMALL_VALUES, count_quantiles, melt, quantiles_of_counts, running_counts, value_counts
from tidemark.plans.shipping import ship_package
from tidemark.plans.storage import freeze

ALPHA = 0.05
SHAPIRO_MIN, SHAPIRO_MAX = 3, 5000
# Sample size up to which the smaller side has the exact distribution of U.
EXACT_U_SMALLER = 8
# Upper limits of the classes negligible, small and medium (fixed values).
EFFECT_LIMITS = {"variance": (0.01, 0.06, 0.14), "cohens_d": (0.2, 0.5, 0.8), "rank_biserial": (0.1, 0.3, 0.5)}
# 5 % point of the Anderson-Darling statistic, mean and variance estimated.
ANDERSON_5_PERCENT = 0.787


def interpret_effect(effect: Column, measure: str) -> Column:
    negligible, small, medium = EFFECT_LIMITS[measure]
    size = F.abs(effect)
    return (
        F.when(effect.isNull(), "unknown")
        .when(size < negligible, "negligible")
        .when(size < small, "small")
        .when(size < medium, "medium")
        .otherwise("large")
    )


_KEYS = ["column", "grp"]


def grouped_values(df: DataFrame, group: str, targets: Sequence[str]) -> DataFrame:
    """Long form (column, grp, value) of several targets over the groups."""
    require_columns(df, [group, *targets])
    present = df.where(F.col(f"`{group}`").isNotNull()).withColumn("grp", F.col(f"`{group}`").cast("string"))
    return melt(present, targets, ["grp"])


def grouped_counts(long: DataFrame, min_size: int = 1) -> DataFrame:
    """Stored (column, grp, value, c): equal values of a group merged, small groups left out.

    Medians and rank tests read this table instead of the input.
    """
    counts = freeze(value_counts(long, _KEYS))
    if min_size <= 1:
        return counts
    sizes = counts.groupBy(*_KEYS).agg(F.sum("c").alias("__n")).where(F.col("__n") >= min_size)
    return attach(counts, sizes, _KEYS).drop("__n")


def ranked_counts(counts: DataFrame) -> DataFrame:
    """Stored ``counts`` with their places, from one sort by value.

    Adds ``before`` and ``total`` (rows of the group with a smaller value, and all) and
    ``below``, ``same`` and ``everyone`` (those of all groups together).
    """
    blocked = blocks_in_order(counts, ["column"], ["value"])
    earlier = lambda *by: W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    first = lambda of, *by: F.coalesce(F.sum(of).over(earlier(*by)), F.lit(0))
    per_group = blocked.groupBy(*_KEYS, "__block").agg(F.sum("c").alias("__c"))
    per_column = freeze(blocked.groupBy("column", "__block").agg(F.sum("c").alias("__c")))
    of_group = freeze(
        per_group.select(*_KEYS, "__block", first("__c", *_KEYS).alias("__g"), F.sum("__c").over(W.partitionBy(*_KEYS)).alias("total"))
    )
    of_column = freeze(
        per_column.select(
            "column", "__block", first("__c", "column").alias("__a"), F.sum("__c").over(W.partitionBy("column")).alias("everyone")
        )
    )
    by_value = W.partitionBy("column", "__block").orderBy("value")
    inside = W.partitionBy(*_KEYS, "__block").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    # a block holds all rows of a value
    local = (
        blocked.withColumn("same", F.sum("c").over(by_value.rangeBetween(W.currentRow, W.currentRow)))
        .withColumn("__l", F.sum("c").over(by_value.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.col("same"))
        .withColumn("__b", F.coalesce(F.sum("c").over(inside), F.lit(0)))
    )
    placed = attach(attach(local, of_group, [*_KEYS, "__block"], stored=True), of_column, ["column", "__block"], stored=True)
    return freeze(
        placed.select(
            *_KEYS, "value", "c", (F.col("__g") + F.col("__b")).alias("before"), "total",
            (F.col("__a") + F.col("__l")).alias("below"), "same", "everyone",
        )
    )


def group_moments(long: DataFrame, min_size: int = 1) -> DataFrame:
    """Per group: n, mean, sample deviation, extremes and inner sum of squares."""
    n = F.count(F.lit(1))
    return (
        long.groupBy(*_KEYS)
        .agg(
            n.alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            (F.var_pop("value") * n).alias("within"),
        )
        .where(F.col("n") >= min_size)
    )


def _f_test(moments: DataFrame) -> DataFrame:
    """One-way F statistic per column from group sizes, means and inner sums of squares."""
    stored = freeze(moments)
    grand = stored.groupBy("column").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).collect()
    if not grand:
        raise ValueError("no groups to compare")
    # One overall mean per tested column.
    of_column = F.create_map(*[x for r in grand for x in (F.lit(r["column"]), F.lit(r["m"]))])[F.col("column")]
    gap = F.col("mean") - of_column
    sums = (
        stored.groupBy("column")
        .agg(
            F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum("within").alias("inner"),
        )
        .where("groups > 1 and total > groups")
    )
    d1, d2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    f = F.when(F.col("inner") > 0, (F.col("between") / d1) / (F.nullif(F.col("inner"), F.lit(0.0)) / d2)).otherwise(
        F.when(F.col("between") > 0, F.lit(float("inf")))
    )
    return (
        sums.withColumn("statistic", f)
        .withColumn("df_between", d1)
        .withColumn("df_within", d2)
        .withColumn("p_value", f_sf(F.col("statistic"), d1, d2))
        .withColumn("eta_squared", F.col("between") / F.nullif(F.col("between") + F.col("inner"), F.lit(0.0)))
        .select("column", "groups", F.col("total").alias("n"), "statistic", "df_between", "df_within", "p_value",
                "eta_squared")
    )


def anova_of(long: DataFrame, min_size: int = 1) -> DataFrame:
    return _f_test(group_moments(long, min_size))


def anova(df: DataFrame, group: str, targets: Sequence[str], min_size: int = 1) -> DataFrame:
    """One-way ANOVA of each target over the groups, with eta²."""
    return anova_of(grouped_values(df, group, targets), min_size)


def levene_of(long: DataFrame, counts: DataFrame, small_values: int = SMALL_VALUES) -> DataFrame:
    return levene_around(long, count_quantiles(counts, _KEYS, {"__median": 0.5}, small_values))


def levene_around(long: DataFrame, medians: DataFrame) -> DataFrame:
    spread = attach(long, medians, _KEYS).select(*_KEYS, F.abs(F.col("value") - F.col("__median")).alias("value"))
    return anova_of(spread).drop("eta_squared")


def levene(
    df: DataFrame, group: str, targets: Sequence[str], min_size: int = 1, small_values: int = SMALL_VALUES
) -> DataFrame:
    """Levene's test around group medians: ANOVA of the absolute deviations."""
    long = grouped_values(df, group, targets)
    return levene_of(long, grouped_counts(long, min_size), small_values)


def kruskal_of(ranked: DataFrame) -> DataFrame:
    """From ``ranked_counts``."""
    c, t = F.col("c"), F.col("same").cast("double")
    u = F.col("below") + (F.col("same") + 1) / 2 - (F.col("everyone") + 1) / 2
    # each of the rows that share a value adds its part of t³ - t
    facts = (
        ranked.groupBy("column", "grp")
        .agg(F.sum(c * u).alias("r"), F.sum("c").alias("n"), F.sum(c * (t * t - 1)).alias("own_ties"), F.max("everyone").alias("total"))
        .groupBy("column")
        .agg(
            F.sum(F.col("r") * F.col("r") / F.col("n")).alias("spread"), F.count(F.lit(1)).alias("groups"),
            F.sum("own_ties").alias("ties"), F.max("total").alias("total"),
        )
        .where("groups > 1")
    )
    n = F.col("total").cast("double")
    correction = 1 - F.col("ties") / F.nullif(n * n * n - n, F.lit(0.0))
    h = 12.0 / (n * (n + 1)) * F.col("spread") / F.nullif(correction, F.lit(0.0))
    return (
        facts.withColumn("statistic", h)
        .withColumn("p_value", chi2_sf(F.col("statistic"), F.col("groups") - 1))
        .withColumn(
            "epsilon_squared",
            F.greatest(
                F.lit(0.0), (F.col("statistic") - F.col("groups") + 1) / F.nullif(n - F.col("groups"), F.lit(0.0))
            ),
        )
        .select("column", "groups", F.col("total").alias("n"), "statistic", "p_value", "epsilon_squared")
    )


def kruskal(df: DataFrame, group: str, targets: Sequence[str], min_size: int = 1) -> DataFrame:
    """Kruskal-Wallis H, tie-corrected, with epsilon²."""
    return kruskal_of(ranked_counts(grouped_counts(grouped_values(df, group, targets), min_size)))


def shapiro_of(counts: DataFrame) -> DataFrame:
    sizes = counts.groupBy(*_KEYS).agg(F.sum("c").alias("__n")).where(F.col("__n").between(SHAPIRO_MIN, SHAPIRO_MAX))
    return _shapiro(attach(counts, sizes, _KEYS))


def _shapiro(fitting: DataFrame) -> DataFrame:
    ship_package(fitting.sparkSession)

    def test(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sample = np.repeat(frame["value"].to_numpy(), frame["c"].to_numpy())
        w, p = shapiro_wilk(sample)
        return pd.DataFrame({"column": [key[0]], "grp": [key[1]], "n": [len(sample)], "statistic": [w], "p_value": [p]})

    schema = "column string, grp string, n long, statistic double, p_value double"
    return fitting.select(*_KEYS, "value", "c").groupBy(*_KEYS).applyInPandas(test, schema).withColumn("normal", F.col("p_value") > ALPHA)


def anderson_p(statistic: Column, n: Column) -> Column:
    """p-value of the Anderson-Darling statistic with mean and variance estimated.

    Fixed values: the published four-piece approximation for the statistic
    adjusted to the sample size.
    """
    a = F.least(statistic * (1 + 0.75 / n + 2.25 / (n * n)), F.lit(13.0))
    return (
        F.when(a < 0.2, 1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a))
        .when(a < 0.34, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a))
        .when(a < 0.6, F.exp(0.9177 - 4.279 * a - 1.38 * a * a))
        .otherwise(F.exp(1.2937 - 5.709 * a + 0.0186 * a * a))
    )


def normality_of(ranked: DataFrame) -> DataFrame:
    """(column, grp, n, test, statistic, p_value, normal) of every group of three or more values, from ``ranked_counts``.

    Shapiro-Wilk where it is defined, up to 5000 values, and Anderson-Darling above.
    """
    names = ["n", "test", "statistic", "p_value", "normal"]
    small = _shapiro(ranked.where(F.col("total").between(SHAPIRO_MIN, SHAPIRO_MAX))).withColumn("test", F.lit("shapiro_wilk"))
    small = small.select(*_KEYS, *names)
    large = ranked.where(F.col("total") > SHAPIRO_MAX)
    if large.isEmpty():
        return small
    tested = anderson_of_ranked(large, _KEYS).withColumn("p_value", anderson_p(F.col("statistic"), F.col("n")))
    tested = tested.withColumns({"test": F.lit("anderson_darling"), "normal": F.col("p_value") > ALPHA})
    return small.union(tested.select(*_KEYS, *names))


def shapiro(df: DataFrame, group: str, targets: Sequence[str]) -> DataFrame:
    """Normality per group: Shapiro-Wilk for 3 to 5000 values, Anderson-Darling for larger groups."""
    return normality_of(ranked_counts(grouped_counts(grouped_values(df, group, targets))))


def anderson_darling(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Anderson-Darling statistic for normality, from running counts of distinct values."""
    return anderson_of(freeze(value_counts(melt(df, columns), ["column"])), ["column"])


def anderson_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The statistic per key, from (keys, value, c)."""
    return anderson_of_ranked(freeze(running_counts(counts, keys)), keys)


def anderson_of_ranked(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The statistic per key, from stored (keys, value, c, before, total)."""
    ship_package(counted.sparkSession)
    c, b, n = F.col("c"), F.col("before"), F.col("total")
    means = freeze(counted.groupBy(*keys).agg((F.sum(F.col("value") * c) / F.sum(c)).alias("m"), F.sum(c).alias("__size")))
    gap = F.col("value") - F.col("m")
    spread = attach(counted, means, keys, stored=True).groupBy(*keys).agg(F.sum(c * gap * gap).alias("__ss"))
    moments = null_safe_join(means, spread, keys).select(
        *keys, "m", F.sqrt(F.col("__ss") / F.nullif(F.col("__size") - 1, F.lit(0))).alias("s")
    )

    @F.pandas_udf("low double, high double")
    def log_tails(z: pd.Series) -> pd.DataFrame:
        low, high = log_normal_tails(z.to_numpy())
        return pd.DataFrame({"low": low, "high": high})

    lower = c * (2 * b + c).cast("double") * F.col("log.low")
    upper = c * (2 * n - 2 * b - c).cast("double") * F.col("log.high")
    summed = (
        attach(counted, moments, keys)
        .withColumn("z", gap / F.nullif(F.col("s"), F.lit(0.0)))
        .where("z is not null")
        .withColumn("log", log_tails("z"))
        .groupBy(*keys, "total")
        .agg(F.sum(lower + upper).alias("terms"))
    )
    critical = ANDERSON_5_PERCENT / (1 + 4 / n - 25 / (n * n))
    return summed.select(
        *keys,
        n.alias("n"),
        (-n - F.col("terms") / n).alias("statistic"),
        F.round(critical, 3).alias("critical_value"),
        ((-n - F.col("terms") / n) < F.round(critical, 3)).alias("is_normal"),
    )


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk for columns of 8 to 5000 values, Anderson-Darling for longer ones."""
    sizes = {
        r["column"]: r["n"] for r in melt(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    short = [c for c in columns if 8 <= sizes.get(c, 0) <= SHAPIRO_MAX]
    long = [c for c in columns if sizes.get(c, 0) > SHAPIRO_MAX]
    out = df.sparkSession.createDataFrame(
        [], "column string, test string, statistic double, p_value double, is_normal boolean"
    )
    if short:
        counts = value_counts(melt(df, short), ["column"]).withColumn("grp", F.lit("all"))
        tested = shapiro_of(freeze(counts))
        out = out.union(tested.select("column", F.lit("shapiro_wilk"), "statistic", "p_value", "normal"))
    if long:
        tested = anderson_darling(df, long)
        out = out.union(
            tested.select("column", F.lit("anderson_darling"), "statistic", F.lit(None).cast("double"), "is_normal")
        )
    return out


def mean_intervals(df: DataFrame, group: str, targets: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Confidence interval of each group mean by Student's distribution (two or more values)."""
    n = F.col("n")
    margin = F.col("t") * F.col("std") / F.sqrt(n)
    return (
        group_moments(grouped_values(df, group, targets))
        .where(n >= 2)
        .withColumn("t", t_ppf(1 - (1 - confidence) / 2, n - 1))
        .select(
            "column",
            "grp",
            "n",
            "mean",
            margin.alias("margin_error"),
            (F.col("mean") - margin).alias("lower"),
            (F.col("mean") + margin).alias("upper"),
        )
    )


def _exact_u_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) for two samples without ties, from the counts of all orderings."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    small, large = min(n1, n2), max(n1, n2)
    for k in range(1, small + 1):
        grown = counts.copy()
        grown[large + k :] -= counts[: len(counts) - large - k]
        # running sums at distance k: one column per remainder
        wide = np.zeros(-(-len(grown) // k) * k)
        wide[: len(grown)] = grown
        counts = np.cumsum(wide.reshape(-1, k), axis=0).ravel()[: len(grown)]
    return float(counts[int(math.ceil(u)) :].sum() / counts.sum())


def mann_whitney_p(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Two-sided p-value: exact for small samples without ties, else normal with continuity."""
    ship_package()

    @F.pandas_udf("double")
    def evaluate(us: pd.Series, a: pd.Series, b: pd.Series, tied: pd.Series) -> pd.Series:
        out = []
        for u1, m, k, t in zip(us, a, b, tied):
            top, n = max(u1, m * k - u1), m + k
            if t == 0 and min(m, k) <= EXACT_U_SMALLER:
                out.append(min(1.0, 2.0 * _exact_u_tail(top, int(m), int(k))))
                continue
            variance = m * k / 12.0 * (n + 1 - t / (n * (n - 1.0)))
            z = (top - m * k / 2.0 - 0.5) / math.sqrt(variance) if variance > 0 else 0.0
            out.append(min(1.0, 2.0 * normal_tail(z)))
        return pd.Series(out)

    return evaluate(u.cast("double"), n1.cast("double"), n2.cast("double"), ties.cast("double"))


def pairwise_mann_whitney(df: DataFrame, group: str, target: str, min_size: int = 3) -> DataFrame:
    """Mann-Whitney U of every pair of groups with the rank-biserial correlation.

    Groups are numbered by name; the pairs come from merging sorted value counts.
    """
    cells = grouped_counts(grouped_values(df, group, [target]), min_size)
    cube = F.col("c").cast("double") * (F.col("c").cast("double") * F.col("c") - 1)
    sizes = cells.groupBy("grp").agg(F.sum("c").alias("n"), F.sum(cube).alias("own_ties"))
    numbered = freeze(with_position(sizes, ["grp"], pos="gid", size="groups"))
    groups = numbered.count()
    if groups < 2:
        raise ValueError("need at least two groups")
    keyed = freeze(attach(cells, numbered.select("grp", "gid"), ["grp"], stored=True).select("gid", "value", "c"))
    pairs = pair_sums(keyed, groups)
    medians = count_quantiles(cells, ["grp"], {"median": 0.5})
    stats = freeze(null_safe_join(numbered, medians, ["grp"]))
    first_of, second_of = (
        stats.select(
            F.col("gid").alias(at), F.col("grp").alias(f"group{k}"), F.col("n").alias(f"n{k}"),
            F.col("median").alias(f"median{k}"), F.col("own_ties").alias(f"own_ties{k}"),
        )
        for at, k in (("i", 1), ("j", 2))
    )
    r = 1 - 2 * F.col("statistic") / (F.col("n1") * F.col("n2"))
    return (
        attach(attach(pairs, first_of, ["i"], stored=True), second_of, ["j"], stored=True)
        .withColumn("ties", F.col("shared_ties") + F.col("own_ties1") + F.col("own_ties2"))
        .withColumnRenamed("u", "statistic")
        .withColumn("p_value", mann_whitney_p(F.col("statistic"), F.col("n1"), F.col("n2"), F.col("ties")))
        .withColumn("rank_biserial", r)
        .select(
            "group1", "group2", "n1", "n2", "statistic", "p_value",
            (F.col("p_value") < ALPHA).alias("significant"),
            "rank_biserial",
            interpret_effect(F.col("rank_biserial"), "rank_biserial").alias("interpretation"),
            "median1", "median2",
        )
    )


def _moment_pairs(long: DataFrame, min_size: int) -> DataFrame:
    m = freeze(group_moments(long, max(2, min_size)))
    a = m.select("column", *[F.col(c).alias(f"{c}1") for c in ("grp", "n", "mean", "std")])
    b = m.select("column", *[F.col(c).alias(f"{c}2") for c in ("grp", "n", "mean", "std")])
    # One row per group and column on both sides: the result is the pair table itself.
    return a.join(b, "column").where("grp1 < grp2")


def pairwise_t_tests(df: DataFrame, group: str, targets: Sequence[str], min_size: int = 3) -> DataFrame:
    """Pooled t-test of every pair of groups, Cohen's d and the interval of the mean difference."""
    n1, n2 = F.col("n1"), F.col("n2")
    v1, v2 = F.col("std1") * F.col("std1"), F.col("std2") * F.col("std2")
    dof = n1 + n2 - 2
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / dof)
    gap = F.col("mean1") - F.col("mean2")
    pairs = (
        _moment_pairs(grouped_values(df, group, targets), min_size)
        .withColumn("pooled", F.nullif(pooled, F.lit(0.0)))
        .withColumn("mean_difference", gap)
        .withColumn("statistic", gap / (F.col("pooled") * F.sqrt(1 / n1 + 1 / n2)))
        .withColumn("cohens_d", gap / F.col("pooled"))
        .withColumn("p_value", t_sf2(F.col("statistic"), dof))
        .withColumn("reach", t_ppf(0.975, dof) * F.sqrt(v1 / n1 + v2 / n2))
    )
    return pairs.select(
        "column",
        F.col("grp1").alias("group1"),
        F.col("grp2").alias("group2"),
        "n1",
        "n2",
        "statistic",
        "p_value",
        (F.col("p_value") < ALPHA).alias("significant"),
        "cohens_d",
        interpret_effect(F.col("cohens_d"), "cohens_d").alias("interpretation"),
        "mean_difference",
        (F.col("mean_difference") - F.col("reach")).alias("ci_lower"),
        (F.col("mean_difference") + F.col("reach")).alias("ci_upper"),
    )


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = ALPHA, null_as_one: bool = True) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, with the Bonferroni and Šidák levels.

    ``tests`` holds one row per test.  Equal p-values share the largest rank, so
    the result does not depend on row order; ranks come from a distributed count.
    """
    col = F.col(f"`{p}`")
    raw = F.coalesce(col, F.lit(1.0)) if null_as_one else col
    tested = freeze(tests.withColumn("__p", raw))
    distinct = tested.where("__p is not null").groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sums(distinct, [], ["__p"], {"before": "c"}, {"tests": "c"})
    scaled = ranked.withColumn("__q", F.col("__p") * F.col("tests") / (F.col("before") + F.col("c")))
    # The adjusted value is the smallest scaled value at or above p.
    adjusted = minimum_from_here(scaled, [], ["__p"], "__q", "__lowest").select(
        "__p", "tests", F.least(F.lit(1.0), F.col("__lowest")).alias("p_value_corrected")
    )
    return (
        attach(tested, adjusted, ["__p"], "left")
        .drop("__p")
        .withColumns(
            {
                "significant_corrected": F.col("p_value_corrected") <= alpha,
                "alpha_bonferroni": F.lit(alpha) / F.col("tests"),
                "alpha_sidak": 1 - F.pow(F.lit(1 - alpha), 1 / F.col("tests")),
            }
        )
    )


def correction_summary(corrected: DataFrame, p: str = "p_value", alpha: float = ALPHA) -> DataFrame:
    """Number of tests, and how many are significant before and after correction."""
    return corrected.agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col(f"`{p}`") < alpha).alias("significant_before_correction"),
        F.count_if("significant_corrected").alias("significant_after_correction"),
    )


def compare_groups(df: DataFrame, group: str, targets: Sequence[str], min_size: int = 3) -> DataFrame:
    """ANOVA where every group looks normal and variances agree, else Kruskal-Wallis.

    Medians, normality and rank sums read one table sorted by value.
    Normality is by Shapiro-Wilk up to 5000 values of a group and by Anderson-Darling above.
    """
    long = grouped_values(df, group, targets)
    ranked = ranked_counts(grouped_counts(long, min_size))
    normal = normality_of(ranked).groupBy("column").agg(F.min("p_value").alias("lowest_normal_p"))
    equal = levene_around(long, quantiles_of_counts(ranked, _KEYS, {"__median": 0.5})).select("column", F.col("p_value").alias("levene_p"))
    # what was not tested is not taken for normal
    met = (F.coalesce("lowest_normal_p", F.lit(0.0)) > ALPHA) & (F.coalesce("levene_p", F.lit(0.0)) > ALPHA)
    checked = freeze(null_safe_join(equal, normal, ["column"], "left").withColumn("assumptions_met", met))
    # One row per target: only the test that applies is then computed.
    flags = {r["column"]: r["assumptions_met"] for r in checked.select("column", "assumptions_met").collect()}
    if not flags:
        raise ValueError("need at least two groups of the wanted size")
    parts = []
    for wanted, name, measure in ((True, "anova", "eta_squared"), (False, "kruskal_wallis", "epsilon_squared")):
        chosen = F.col("column").isin([c for c, flag in flags.items() if flag == wanted])
        if wanted in flags.values():
            tested = anova_of(long.where(chosen), min_size) if wanted else kruskal_of(ranked.where(chosen))
            parts.append(
                tested.select(
                    "column", "groups", "n", F.lit(name).alias("test"), "statistic", "p_value",
                    F.col(measure).alias("effect_size"), F.lit(measure).alias("effect_measure"),
                )
            )
    results = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return null_safe_join(results, checked, ["column"]).select(
        "column", "groups", "n", "test", "statistic", "p_value",
        (F.col("p_value") < ALPHA).alias("significant"),
        "effect_size", "effect_measure",
        interpret_effect(F.col("effect_size"), "variance").alias("interpretation"),
        "lowest_normal_p", "levene_p", "assumptions_met",
    )


def follow_up(df: DataFrame, group: str, compared: DataFrame) -> DataFrame:
    """(column, group1, group2, test, statistic, p_value) of all pairs of groups of the targets that differ.

    ``compared`` is the result of ``compare_groups``: t-tests follow an ANOVA,
    Mann-Whitney tests a Kruskal-Wallis test.  p-values are not corrected yet.
    """
    # One row per target.
    chosen = {r["column"]: r["test"] for r in compared.where("significant").select("column", "test").collect()}
    names = ["group1", "group2", "test", "statistic", "p_value"]
    out = df.sparkSession.createDataFrame(
        [], "column string, group1 string, group2 string, test string, statistic double, p_value double"
    )
    for target, test in chosen.items():
        if test == "anova":
            pairs = pairwise_t_tests(df, group, [target]).withColumn("test", F.lit("t_test"))
        else:
            pairs = pairwise_mann_whitney(df, group, target).withColumn("test", F.lit("mann_whitney"))
        out = out.union(pairs.select(F.lit(target).alias("column"), *names))
    return out


def compare_two_groups(df: DataFrame, group: str, first: str, second: str, target: str) -> DataFrame:
    """Pooled t-test if both samples look normal with equal variance, else Mann-Whitney."""
    two = df.where(F.col(f"`{group}`").cast("string").isin(first, second))
    chosen = compare_groups(two, group, [target]).select("lowest_normal_p", "levene_p", "assumptions_met")
    t = pairwise_t_tests(two, group, [target])
    u = pairwise_mann_whitney(two, group, target).select(
        "group1", "group2", F.col("statistic").alias("u"), F.col("p_value").alias("u_p"), "rank_biserial",
        "median1", "median2",
    )
    met = F.col("assumptions_met")
    p = F.when(met, F.col("p_value")).otherwise(F.col("u_p"))
    # Each side is one row: the single pair of groups.
    return (
        t.join(u, ["group1", "group2"])
        .withColumn("__k", F.lit(1))
        .join(chosen.withColumn("__k", F.lit(1)), "__k")
        .select(
            "group1", "group2", "n1", "n2",
            F.when(met, "t_test").otherwise("mann_whitney").alias("test"),
            F.when(met, F.col("statistic")).otherwise(F.col("u")).alias("statistic"),
            p.alias("p_value"),
            (p < ALPHA).alias("significant"),
            "cohens_d", "interpretation", "mean_difference", "ci_lower", "ci_upper", "median1", "median2",
        )
    )


def group_analysis(
    df: DataFrame, group: str, targets: Sequence[str], small_values: int = SMALL_VALUES
) -> DataFrame:
    """Per group and target: basic, robust and interval statistics in one table."""
    from tidemark.operators.aggregate import robust_statistics

    basic = group_moments(grouped_values(df, group, targets)).drop("within")
    robust = robust_statistics(df, group, targets, small_values).withColumn("grp", F.col(f"`{group}`").cast("string"))
    interval = mean_intervals(df, group, targets).select("column", "grp", "lower", "upper")
    keys = ["column", "grp"]
    picked = robust.select(*keys, "median", "q25", "q75", "iqr", "mad", "lower_fence", "upper_fence")
    return null_safe_join(null_safe_join(basic, picked, keys), interval, keys, "left").withColumn(
        "std", F.coalesce("std", F.lit(0.0))
    )


def linear_trend(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of the value on its position in the series, per key.

    ``order`` must order the rows of a series without ties.
    """
    present = df.where(as_double(df, value).isNotNull())
    return trend_of_positions(with_position(present, order, keys), value, keys)


def trend_of_positions(placed: DataFrame, value: str, keys: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    x, y = F.col(pos).cast("double"), F.col(f"`{value}`").cast("double")
    fit = placed.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.count(y).alias("n"),
        F.covar_pop(x, y).alias("xy"),
        F.var_pop(F.when(y.isNotNull(), x)).alias("xx"),
        F.var_pop(y).alias("yy"),
        F.avg(F.when(y.isNotNull(), x)).alias("mx"),
        F.avg(y).alias("my"),
    )
    slope = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    r = F.coalesce(F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)), F.lit(0.0))
    n = F.col("n")
    left = F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0))
    t = F.col("r") * F.sqrt((n - 2) / F.nullif(left, F.lit(0.0)))
    stderr = F.sqrt(left * F.col("yy") / F.nullif(F.col("xx"), F.lit(0.0)) / F.nullif(n - 2, F.lit(0)))
    return (
        fit.where(n > 1)
        .withColumn("slope", slope)
        .withColumn("r", r)
        .withColumn("std_err", stderr)
        .withColumn(
            "p_value", F.when((left == 0) & (n > 2), 0.0).when(n > 2, t_sf2(t, F.when(n > 2, n - 2)))
        )
        .select(
            *[F.col(f"`{k}`") for k in keys],
            "n",
            "slope",
            (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
            "r",
            "p_value",
            "std_err",
        )
    )
