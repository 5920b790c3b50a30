"""Outliers, multivariate anomalies, business rules and series anomalies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.moments import percent
from tidemark.functions.summaries import summarise
from tidemark.functions.types import as_double, is_missing, numeric_columns, require_columns, string_columns
from tidemark.operators.derive import clock_columns
from tidemark.operators.envelope import elliptic_envelope
from tidemark.operators.forest import isolation_forest
from tidemark.operators.hypothesis import normality
from tidemark.plans.ordered import rolling, with_position
from tidemark.plans.quantiles import SMALL_VALUES, quantiles
from tidemark.plans.storage import freeze

METHODS = ("iqr", "zscore", "isolation_forest", "elliptic_envelope")
# Preset parameters per method (fixed values).
PRESETS = {"iqr": {"multiplier": 1.5}, "zscore": {"threshold": 2.5}, "isolation_forest": {"contamination": 0.05}}
IQR_MULTIPLIER = 1.5
Z_THRESHOLD = 3.0
SERIES_THRESHOLD = 2.0
LAGS = (1, 7, 30)
# Fewest points of a series that is judged.
SERIES_LEAST = 10


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER, small_values: int = SMALL_VALUES
) -> DataFrame:
    """Lower and upper fence of every column with a positive IQR."""
    iqr = F.col("q3") - F.col("q1")
    return quantiles(df, columns, {"q1": 0.25, "q3": 0.75}, small_values=small_values).where(iqr > 0).select(
        "column", (F.col("q1") - multiplier * iqr).alias("lower_bound"), (F.col("q3") + multiplier * iqr).alias("upper_bound")
    )


def _iqr_tests(df: DataFrame, columns: Sequence[str], multiplier: float, small_values: int) -> dict[str, Column]:
    # One row per column, so the fences become literals and the rows are only filtered.
    bounds = {r["column"]: r for r in iqr_bounds(df, columns, multiplier, small_values).collect()}
    return {
        c: (as_double(df, c) < F.lit(bounds[c]["lower_bound"])) | (as_double(df, c) > F.lit(bounds[c]["upper_bound"]))
        for c in columns
        if c in bounds
    }


def _z_scores(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    stats = summarise(
        df, columns, lambda c: {"m": F.avg(as_double(df, c)), "s": F.stddev_pop(as_double(df, c))}
    ).where("s > 0")
    return {r["column"]: (as_double(df, r["column"]) - F.lit(r["m"])) / F.lit(r["s"]) for r in stats.collect()}


def _any(tests: Mapping[str, Column]) -> Column:
    if not tests:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests.values()])


def iqr_summary(
    df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER, small_values: int = SMALL_VALUES
) -> DataFrame:
    """Outlier count and fences per column; a column without an IQR is left out."""
    bounds = {r["column"]: r for r in iqr_bounds(df, columns, multiplier, small_values).collect()}
    kept = [c for c in columns if c in bounds]
    if not kept:
        return df.sparkSession.createDataFrame(
            [], "column string, outlier_count long, lower_bound double, upper_bound double"
        )

    def stats(c: str) -> dict[str, Column]:
        low, high, x = F.lit(bounds[c]["lower_bound"]), F.lit(bounds[c]["upper_bound"]), as_double(df, c)
        return {
            "outlier_count": F.count_if((x < low) | (x > high)),
            "lower_bound": F.max(low),
            "upper_bound": F.max(high),
        }

    return summarise(df, kept, stats)


def zscore_summary(df: DataFrame, columns: Sequence[str], threshold: float = Z_THRESHOLD) -> DataFrame:
    """Outlier count and largest \\|z\\| per column with spread."""
    scores = _z_scores(df, columns)
    if not scores:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long, max_zscore double")
    return summarise(
        df,
        list(scores),
        lambda c: {
            "outlier_count": F.count_if(F.abs(scores[c]) > threshold),
            "max_zscore": F.max(F.abs(scores[c])),
        },
    )


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    methods: Sequence[str] = ("iqr", "zscore", "isolation_forest"),
    keys: Sequence[str] | None = None,
    contamination: float = 0.1,
    multiplier: float = IQR_MULTIPLIER,
    threshold: float = Z_THRESHOLD,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Every row with a flag per method, the number of methods that hit, and the consensus.

    ``keys`` identify a row for the sampling models; all columns by default.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown outlier methods: {unknown}")
    columns = numeric_columns(df) if columns is None else list(columns)
    require_columns(df, columns)
    keys = df.columns if keys is None else list(keys)
    out = df
    for m in methods:
        if m == "iqr":
            out = out.withColumn(m, _any(_iqr_tests(df, columns, multiplier, small_values)))
        elif m == "zscore":
            tests = {c: F.abs(z) > threshold for c, z in _z_scores(df, columns).items()}
            out = out.withColumn(m, _any(tests))
        else:
            model = isolation_forest if m == "isolation_forest" else elliptic_envelope
            flagged = model(out, columns, keys, contamination, small_values=small_values)
            out = flagged.withColumnRenamed("is_anomaly", m).drop("score")
    hits = reduce(lambda a, b: a + b, [F.col(m).cast("int") for m in methods])
    return out.withColumn("methods_hit", hits).withColumns(
        {"is_outlier": F.col("methods_hit") >= 1, "is_consensus": F.col("methods_hit") >= 2}
    )


def outlier_summary(flagged: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Rows hit per method, in total and by two or more methods."""
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(m).alias(m) for m in methods],
        F.count_if("is_outlier").alias("total_outliers"),
        percent(F.count_if("is_outlier"), F.count(F.lit(1))).alias("outlier_percentage"),
        F.count_if("is_consensus").alias("consensus_outliers"),
    )


def outlier_sample(flagged: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The first ``k`` flagged rows by key."""
    return flagged.where("is_outlier").orderBy(*keys).limit(k)


def check_assumptions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share, distinct values, sample size and normality per column, with warnings."""
    facts = summarise(
        df,
        columns,
        lambda c: {
            "rows": F.count(F.lit(1)),
            "data_points": F.count(as_double(df, c)),
            "missing_percentage": percent(F.count_if(is_missing(df, c)), F.count(F.lit(1))),
            "unique_values": F.count_distinct(as_double(df, c)),
        },
    )
    tested = normality(df, columns).withColumnRenamed("column", "__c")
    warning = F.array_compact(
        F.array(
            F.when(F.col("rows") < 10, F.lit("too_small")),
            F.when(F.col("missing_percentage") > 50, F.lit("mostly_missing")),
            F.when(F.col("unique_values") == 1, F.lit("no_variance")),
            F.when((F.col("unique_values") == 2) & (F.col("data_points") > 10), F.lit("very_low_variance")),
        )
    )
    return (
        facts.join(tested, F.col("column") == F.col("__c"), "left")
        .withColumn("warnings", F.array_join(warning, ","))
        .select("column", "data_points", "missing_percentage", "unique_values", "test", "statistic", "p_value",
                "is_normal", "warnings")
    )


def multivariate_anomalies(
    df: DataFrame,
    features: Sequence[str] | None = None,
    contamination: float = 0.1,
    method: str = "isolation_forest",
    keys: Sequence[str] | None = None,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Complete rows with the model's ``score`` (low = anomalous) and ``is_anomaly``."""
    features = numeric_columns(df) if features is None else [c for c in features if c in numeric_columns(df)]
    if len(features) < 2:
        raise ValueError("need at least two numeric features")
    model = {"isolation_forest": isolation_forest, "elliptic_envelope": elliptic_envelope}[method]
    keys = df.columns if keys is None else list(keys)
    return model(df, features, keys, contamination, small_values=small_values).where("score is not null")


def anomaly_score_summary(flagged: DataFrame, contamination: float = 0.1) -> DataFrame:
    """Counts and the spread of the scores; the threshold is the ``contamination`` quantile."""
    q = quantiles(flagged, ["score"], {"threshold": contamination}).select("threshold").withColumn("__k", F.lit(1))
    one = flagged.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if("is_anomaly").alias("anomalies_detected"),
        percent(F.count_if("is_anomaly"), F.count(F.lit(1))).alias("anomaly_percentage"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
    )
    return one.withColumn("__k", F.lit(1)).join(q, "__k").drop("__k")


def anomaly_characteristics(
    flagged: DataFrame, features: Sequence[str], flag: str = "is_anomaly", small_values: int = SMALL_VALUES
) -> DataFrame:
    """Mean, deviation and median of the anomalies against all rows, per feature."""
    hit = F.col(f"`{flag}`")
    stats = summarise(
        flagged,
        features,
        lambda c: {
            "all_mean": F.avg(as_double(flagged, c)),
            "all_std": F.coalesce(F.stddev_samp(as_double(flagged, c)), F.lit(0.0)),
            "anomaly_mean": F.avg(F.when(hit, as_double(flagged, c))),
            "anomaly_std": F.coalesce(F.stddev_samp(F.when(hit, as_double(flagged, c))), F.lit(0.0)),
        },
    )
    medians = quantiles(flagged, features, {"all_median": 0.5}, small_values=small_values)
    hit_medians = quantiles(flagged.where(hit), features, {"anomaly_median": 0.5}, small_values=small_values)
    gap = F.abs(F.col("anomaly_mean") - F.col("all_mean"))
    return (
        stats.join(medians, "column")
        .join(hit_medians, "column")
        .withColumns(
            {
                "mean_deviation": gap,
                "std_deviation": F.abs(F.col("anomaly_std") - F.col("all_std")),
                "is_extreme": gap > 2 * F.col("all_std"),
            }
        )
    )


def rule_violation(df: DataFrame, rule: Mapping[str, object]) -> Column:
    """True where a row breaks the rule.

    ``range`` lets nulls pass; ``categorical`` and ``pattern`` (matched from the
    start of the text) count them as violations; ``custom`` is never violated.
    """
    column, kind = rule["column"], rule["type"]
    if column not in df.columns or kind == "custom":
        return F.lit(False)
    col = F.col(f"`{column}`")
    if kind == "range":
        tests = {}
        if rule.get("min") is not None:
            tests["min"] = col < F.lit(rule["min"])
        if rule.get("max") is not None:
            tests["max"] = col > F.lit(rule["max"])
        return _any(tests)
    if kind == "categorical":
        return ~F.coalesce(col.isin(list(rule.get("valid_values", []))), F.lit(False))
    if kind == "null_check":
        return F.lit(False) if rule.get("allow_null", False) else is_missing(df, column)
    if kind == "pattern":
        if not rule.get("pattern") or column not in string_columns(df):
            return F.lit(False)
        return ~F.coalesce(col.rlike(f"^(?:{rule['pattern']})"), F.lit(False))
    raise ValueError(f"unknown rule type: {kind}")


def rule_anomalies(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows breaking any rule with ``violated_rules``, the positions of the rules broken."""
    broken = F.array_compact(F.array(*[F.when(rule_violation(df, r), F.lit(i)) for i, r in enumerate(rules)]))
    return df.withColumn("violated_rules", broken).where(F.size("violated_rules") > 0)


def rule_summary(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Violations per rule, and of any rule (rule_id -1), from one pass."""
    tests = [rule_violation(df, r) for r in rules]
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(_any(dict(enumerate(tests)))).alias("any"),
        *[F.count_if(t).alias(f"r{i}") for i, t in enumerate(tests)],
    )
    share = lambda c: percent(F.col(c), F.col("rows")).alias("violation_percentage")
    lines = [
        F.struct(
            F.lit(-1).alias("rule_id"), F.lit("any").alias("type"), F.lit("").alias("column"),
            F.col("any").alias("violation_count"), share("any"),
        )
    ]
    lines += [
        F.struct(
            F.lit(i).alias("rule_id"), F.lit(r["type"]).alias("type"), F.lit(r["column"]).alias("column"),
            F.col(f"r{i}").alias("violation_count"), share(f"r{i}"),
        )
        for i, r in enumerate(rules)
    ]
    return one.select(F.inline(F.array(*lines)))


def centred_window_size(n: Column) -> Column:
    """min(30, n//4) above 30 rows, else max(3, n//3)."""
    return F.when(n > 30, F.least(F.lit(30), F.floor(n / 4))).otherwise(F.greatest(F.lit(3), F.floor(n / 3)))


def trailing_window_size(n: Column) -> Column:
    """min(7, n//4) above 7 rows, else 3."""
    return F.when(n > 7, F.least(F.lit(7), F.floor(n / 4))).otherwise(F.lit(3))


def _series(
    df: DataFrame, date: str, value: str, ties: Sequence[str], keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    require_columns(df, [date, value, *ties, *keys])
    kept = df.where(F.col(f"`{date}`").isNotNull() & as_double(df, value).isNotNull())
    placed = with_position(kept, [date, *ties], keys)
    return placed.where(F.col("n") >= SERIES_LEAST), kept


def _window_size(placed: DataFrame, keys: Sequence[str], size) -> Column | int:
    """One series has one window size, known up front; several series carry their own."""
    if keys:
        return size(F.col("n")).cast("int")
    row = placed.select(size(F.col("n")).cast("int").alias("w")).first()
    return row["w"] if row else 3


def series_anomalies(
    df: DataFrame,
    date: str,
    value: str,
    ties: Sequence[str],
    keys: Sequence[str] = (),
    threshold: float = SERIES_THRESHOLD,
) -> DataFrame:
    """Each point against the centred rolling mean and deviation of its series.

    ``ties`` makes the order by ``date`` unique; ``keys`` separates several series.
    """
    placed, _ = _series(df, date, value, ties, keys)
    rolled = rolling(placed, keys, value, _window_size(placed, keys, centred_window_size), centred=True)
    z = (F.col(f"`{value}`") - F.col("rolling_mean")) / F.nullif(F.col("rolling_std"), F.lit(0.0))
    return rolled.withColumn("z_score", z).withColumn(
        "is_anomaly", F.coalesce(F.abs("z_score") > threshold, F.lit(False))
    )


def series_anomaly_summary(found: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        percent(F.count_if("is_anomaly"), F.count(F.lit(1))).alias("anomaly_percentage"),
        F.avg(f"`{value}`").alias("mean_value"),
        F.stddev_samp(f"`{value}`").alias("std_value"),
        F.coalesce(F.max(F.abs("z_score")), F.lit(0.0)).alias("max_z_score"),
    )


def series_features(
    df: DataFrame, date: str, value: str, ties: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Calendar parts, lags of 1, 7 and 30 rows and trailing rolling mean and deviation."""
    placed, _ = _series(df, date, value, ties, keys)

    def lags(block) -> dict[str, Column]:
        return {f"lag_{k}": F.lag(f"`{value}`", k).over(block) for k in LAGS}

    size = _window_size(placed, keys, trailing_window_size)
    rolled = rolling(
        placed, keys, value, size, centred=False, max_window=7, extra=lags, reach=max(LAGS)
    )
    return clock_columns(rolled, date)


def series_forest_anomalies(
    df: DataFrame,
    date: str,
    value: str,
    ties: Sequence[str],
    keys: Sequence[str] = (),
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Isolation forest over the series features; contamination 0.1 above 100 rows, else 0.05.

    A series no longer than a lag has no such feature.  Series are therefore
    judged by length, those with the same usable lags together.
    """
    features = freeze(series_features(df, date, value, ties, keys))
    base = [value, "hour", "day_of_week", "day_of_month", "month", "rolling_mean", "rolling_std"]
    found = None
    for i in range(len(LAGS) + 1):
        lags, longer = LAGS[:i], LAGS[i:]
        own = features.where((F.col("n") > F.lit(lags[-1] if lags else 0)) & (F.col("n") <= F.lit(longer[0] if longer else 1 << 62)))
        columns = [*base, *[f"lag_{k}" for k in lags]]
        complete = own.dropna(subset=columns)
        rows = complete.count()
        if rows < 10:
            continue
        part = isolation_forest(
            complete, columns, [*keys, "pos"], 0.1 if rows > 100 else 0.05, small_values=small_values
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no series is long enough to be judged")
    return found


def short_series(
    df: DataFrame, date: str, value: str, ties: Sequence[str], keys: Sequence[str], least: int = SERIES_LEAST
) -> DataFrame:
    """(keys, n, reason) of the series that are too short to be judged."""
    require_columns(df, [date, value, *ties, *keys])
    kept = df.where(F.col(f"`{date}`").isNotNull() & as_double(df, value).isNotNull())
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)
    return sizes.withColumn("reason", F.format_string("%d points, at least %d are needed", "n", F.lit(least)))
