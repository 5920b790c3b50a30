"""Trends, series patterns and seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_double, datetime_columns, numeric_columns, require_columns, string_columns
from tidemark.operators.hypothesis import ALPHA, compare_groups, trend_of_positions
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.ordered import with_position
from tidemark.sources.readers import date_shares

# Period codes (fixed values): the unit to truncate to, and the step between periods.
PERIODS = {
    "s": ("second", "SECOND", 1),
    "min": ("minute", "MINUTE", 1),
    "h": ("hour", "HOUR", 1),
    "D": ("day", "DAY", 1),
    "W": ("week", "DAY", 7),
    "ME": ("month", "MONTH", 1),
    "QE": ("quarter", "MONTH", 3),
    "YE": ("year", "MONTH", 12),
}
PERIOD_ALIASES = {"M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "H": "h", "T": "min", "S": "s"}

# Name parts used to pick a column when none is given (fixed values).
DATE_WORDS = ["date", "time", "day", "month", "year"]
AMOUNT_WORDS = [
    "quantity", "amount", "volume", "demand", "consumption", "usage", "flow", "rate", "power", "energy", "gas",
    "production", "delivery", "supply",
]

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
]


def _moment(df: DataFrame, date: str) -> Column:
    col = F.col(f"`{date}`")
    parsed = F.try_to_timestamp(col) if date in string_columns(df) else col
    return parsed.cast("timestamp_ntz")


def _number(df: DataFrame, value: str) -> Column:
    return F.col(f"`{value}`").try_cast("double") if value in string_columns(df) else as_double(df, value)


def resample(df: DataFrame, date: str, value: str, period: str = "ME") -> DataFrame:
    """Count, mean and sum per period; periods without rows are zero.

    Day and longer periods are labelled by their last day, shorter ones by their
    start, and ``position`` numbers the periods from 0.
    """
    require_columns(df, [date, value])
    code = PERIOD_ALIASES.get(period, period)
    trunc, unit, step = PERIODS[code]
    start = F.date_trunc(trunc, _moment(df, date)).cast("timestamp_ntz")
    bins = (
        df.select(start.alias("period_start"), _number(df, value).alias("v"))
        .where("period_start is not null and v is not null")
        .groupBy("period_start")
        .agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.sum("v").alias("sum"))
    )
    ends = bins.agg(
        F.min("period_start").alias("first"),
        F.timestamp_diff(unit, F.min("period_start"), F.max("period_start")).alias("reach"),
    ).first()
    periods = 0 if ends["first"] is None else ends["reach"] // step + 1
    # The spine is a distributed range: seconds over years are many periods.
    shift = (F.col("id") * step).cast("int")
    origin = F.lit(ends["first"]).cast("timestamp_ntz")
    spine = df.sparkSession.range(periods).select(
        F.col("id").alias("position"), F.timestamp_add(unit, shift, origin).cast("timestamp_ntz").alias("period_start")
    )
    label = F.col("period_start")
    if code in ("W", "ME", "QE", "YE"):
        after = F.timestamp_add(unit, F.lit(step), label).cast("timestamp_ntz")
        label = F.timestamp_add("DAY", F.lit(-1), after)
    return null_safe_join(spine, bins, ["period_start"], "left").select(
        "position",
        label.cast("timestamp_ntz").alias("period"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce("sum", F.lit(0.0)).alias("sum"),
    )


def trend_analysis(df: DataFrame, date: str, value: str, period: str = "ME") -> DataFrame:
    """One row: slope and correlation of the period means, direction, totals and the peak."""
    series = resample(df, date, value, period)
    peak = F.struct(F.col("mean"), -F.col("position"))
    totals = series.agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.sum("count").alias("rows_used"),
        F.avg("mean").alias("average_value"),
        F.sum("sum").alias("total_sum"),
        F.max_by("period", peak).alias("peak_period"),
        F.max("mean").alias("peak_value"),
        F.covar_pop("position", "mean").alias("xy"),
        F.var_pop("position").alias("xx"),
        F.var_pop("mean").alias("yy"),
    ).where("rows_used >= 3")
    slope = F.coalesce(F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)), F.lit(0.0))
    r = F.coalesce(F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)), F.lit(0.0))
    return totals.select(
        "total_periods",
        slope.alias("slope"),
        r.alias("correlation"),
        F.when(F.col("total_periods") < 2, "insufficient_data")
        .when(slope > 0, "increasing")
        .when(slope < 0, "decreasing")
        .otherwise("flat")
        .alias("direction"),
        F.abs(r).alias("strength"),
        "average_value",
        "total_sum",
        "peak_period",
        "peak_value",
    )


def pick_trend_columns(df: DataFrame) -> tuple[str, str]:
    """The first date column (or text column parsing as dates for over half) and number."""
    dates = datetime_columns(df)
    texts = string_columns(df)
    if not dates and texts:
        shares = {r["column"]: r["share"] or 0.0 for r in date_shares(df, texts).collect()}
        dates = [c for c in texts if shares[c] > 0.5]
    numbers = numeric_columns(df)
    if not dates or not numbers:
        raise ValueError("no date column or no numeric column for a trend")
    return dates[0], numbers[0]


def find_trend(df: DataFrame, period: str = "ME") -> DataFrame:
    return trend_analysis(df, *pick_trend_columns(df), period)


def _series(df: DataFrame, date: str, values: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Long form (column, moment, ties…, v) of the non-null values of several series."""
    require_columns(df, [date, *values, *ties])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _number(df, c).alias("v")) for c in values])
    return (
        df.select(_moment(df, date).alias("moment"), *[F.col(f"`{t}`").alias(f"tie_{t}") for t in ties], F.inline(pairs))
        .where("moment is not null and v is not null")
    )


def trend_class(slope: Column, std_err: Column) -> Column:
    return (
        F.when(F.abs(slope) < std_err, "flat").when(slope > 0, "increasing").otherwise("decreasing")
    )


def series_patterns(df: DataFrame, date: str, values: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Trend over row position, volatility and range of each value column.

    Rows are ordered by ``date`` and then by ``ties``, which must make the order unique.
    """
    series = _series(df, date, values, ties)
    placed = with_position(series, ["moment", *[f"tie_{t}" for t in ties]], ["column"])
    trend = trend_of_positions(placed, "v", ["column"])
    spread = series.groupBy("column").agg(
        F.stddev_samp("v").alias("volatility"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return null_safe_join(trend, spread, ["column"]).where("n >= 3").select(
        "column",
        "n",
        trend_class(F.col("slope"), F.col("std_err")).alias("direction"),
        "slope",
        F.abs("r").alias("strength"),
        "p_value",
        (F.col("p_value") < ALPHA).alias("significant"),
        "volatility",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("span"),
    )


def seasonality(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """Whether bucket means (month, weekday, hour) vary by over 10 % of the variance.

    Needs 24 rows and at least two buckets per cycle.
    """
    series = _series(df, date, values, ())
    cycles = F.array(
        F.struct(F.lit("monthly").alias("cycle"), F.month("moment").alias("bucket")),
        F.struct(F.lit("weekly").alias("cycle"), F.weekday("moment").alias("bucket")),
        F.struct(F.lit("hourly").alias("cycle"), F.hour("moment").alias("bucket")),
    )
    means = (
        series.select("column", "v", F.inline(cycles))
        .groupBy("column", "cycle", "bucket")
        .agg(F.avg("v").alias("mean"))
        .groupBy("column", "cycle")
        .agg(F.count(F.lit(1)).alias("buckets"), F.var_samp("mean").alias("variance"))
        .where("buckets > 1")
    )
    whole = series.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.var_samp("v").alias("total_variance"))
    return (
        attach(means, whole.where("n >= 24"), ["column"])
        .withColumn("has_pattern", F.col("variance") > F.col("total_variance") * 0.1)
        .select("column", "cycle", "buckets", "variance", "total_variance", "has_pattern")
    )


def bucket_means(df: DataFrame, date: str, value: str) -> DataFrame:
    """Mean value per month, weekday and hour."""
    cycles = F.array(
        F.struct(F.lit("monthly").alias("cycle"), F.month("moment").alias("bucket")),
        F.struct(F.lit("weekly").alias("cycle"), F.weekday("moment").alias("bucket")),
        F.struct(F.lit("hourly").alias("cycle"), F.hour("moment").alias("bucket")),
    )
    series = _series(df, date, [value], ())
    return (
        series.select("v", F.inline(cycles))
        .groupBy("cycle", "bucket")
        .agg(F.count(F.lit(1)).alias("count"), F.avg("v").alias("mean"))
    )


def pick_seasonal_columns(df: DataFrame) -> tuple[str, str]:
    """Date and amount columns by type and name."""
    dates = datetime_columns(df)
    named = [c for c in string_columns(df) if any(w in c.lower() for w in DATE_WORDS)]
    if not dates and named:
        shares = {r["column"]: r["share"] or 0.0 for r in date_shares(df, named).collect()}
        dates = [c for c in named if shares[c] > 0.5]
    numbers = numeric_columns(df)
    amounts = [c for c in numbers if any(w in c.lower() for w in AMOUNT_WORDS)] or numbers
    if not dates or not amounts:
        raise ValueError("no date column or no numeric column for seasonal analysis")
    return dates[0], amounts[0]


def active_rows(df: DataFrame, value: str) -> DataFrame:
    """Positive rows if the column has no negative value, else non-zero rows."""
    low = df.agg(F.min(as_double(df, value)).alias("low")).first()["low"]
    col = as_double(df, value)
    return df.where(col > 0 if low is not None and low >= 0 else col != 0)


def monthly_statistics(df: DataFrame, date: str, value: str) -> DataFrame:
    """Mean, count and deviation per calendar month over the active rows."""
    active = active_rows(df, value)
    x = as_double(active, value)
    return active.groupBy(F.month(_moment(active, date)).alias("month")).agg(
        F.avg(x).alias("mean"), F.count(x).alias("count"), F.stddev_samp(x).alias("std")
    )


def _peak_and_low(monthly: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    order_high = F.struct(F.col("mean"), -F.col("month"))
    order_low = F.struct(F.col("mean"), F.col("month"))
    spread = (F.max("mean") - F.min("mean")) / F.nullif(F.avg("mean"), F.lit(0.0)) * 100
    return (
        monthly.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.sum("count").alias("rows_used"),
            F.max_by("month", order_high).alias("peak"),
            F.min_by("month", order_low).alias("low"),
            F.max("mean").alias("peak_volume"),
            F.min("mean").alias("low_volume"),
            spread.alias("seasonal_variation"),
        )
        .where("months >= 12")
        .select(
            *keys,
            "rows_used",
            names[F.col("peak") - 1].alias("peak_month"),
            names[F.col("low") - 1].alias("low_month"),
            "peak_volume",
            "low_volume",
            "seasonal_variation",
        )
    )


def seasonal_pattern(df: DataFrame, date: str, value: str) -> DataFrame:
    """Peak and low month and their spread, for twelve months of data."""
    return _peak_and_low(monthly_statistics(df, date, value), [])


def seasonal_test(df: DataFrame, date: str, value: str, min_rows: int = 30) -> DataFrame:
    """Do the months differ?  ANOVA or Kruskal-Wallis over all active rows of each month."""
    active = active_rows(df, value)
    months = active.withColumn("month", F.month(_moment(active, date)))
    return compare_groups(months, "month", [value], min_size=min_rows)


def seasonal_by_category(
    df: DataFrame,
    date: str,
    value: str,
    category: str,
    categories: Sequence[str] | None = None,
    min_rows: int = 1000,
    min_variation: float = 20.0,
) -> DataFrame:
    """Seasonal pattern per category with enough rows and variation over the year."""
    active = active_rows(df, value).where(F.col(f"`{category}`").isNotNull())
    if categories is not None:
        active = active.where(F.col(f"`{category}`").isin(list(categories)))
    x = as_double(active, value)
    monthly = active.groupBy(
        F.col(f"`{category}`").alias("category"), F.month(_moment(active, date)).alias("month")
    ).agg(F.avg(x).alias("mean"), F.count(x).alias("count"))
    found = _peak_and_low(monthly, ["category"])
    return found.where((F.col("rows_used") >= min_rows) & (F.col("seasonal_variation") > min_variation))
