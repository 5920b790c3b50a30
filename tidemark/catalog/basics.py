"""Queries: load-time checks, filters, derived columns, aggregation, description and profile."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, rounded, table, union_all
from tidemark.operators import aggregate as agg
from tidemark.operators import derive, describe, filters, profile
from tidemark.plans.storage import checkpoint_folder
from tidemark.sources import readers

LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    "filter_then_aggregate",
    """SELECT l_returnflag, count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean,
       round(median(l_extendedprice), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max
    FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_linestatus = 'O'
    GROUP BY l_returnflag""",
)
def filter_then_aggregate(spark, folder):
    wanted = {"l_quantity": {"min": 10, "max": 40}, "l_linestatus": "O"}
    kept = filters.apply_filters(table(spark, folder, "lineitem"), wanted)
    return rounded(agg.aggregate(kept, "l_returnflag", "l_extendedprice"), 4)


# --- load-time preparation -------------------------------------------------------


@query(
    "narrowing_plan",
    union_all(
        """SELECT '{c}' AS "column", 'bigint' AS from_type,
           CASE WHEN min("{c}") >= -128 AND max("{c}") <= 127 THEN 'tinyint'
                WHEN min("{c}") >= -32768 AND max("{c}") <= 32767 THEN 'smallint'
                WHEN min("{c}") >= -2147483648 AND max("{c}") <= 2147483647 THEN 'int' ELSE 'bigint' END AS to_type,
           false AS dictionary_candidate FROM orders""",
        ["o_orderkey", "o_custkey"],
    )
    + " UNION ALL "
    + """SELECT 'o_totalprice', 'double', CASE WHEN bool_and(o_totalprice::FLOAT::DOUBLE = o_totalprice)
         THEN 'float' ELSE 'double' END, false FROM orders"""
    + " UNION ALL "
    + union_all(
        """SELECT '{c}', 'string', CASE WHEN count(try_cast("{c}" AS DOUBLE)) = count("{c}") THEN 'double'
           ELSE 'string' END, count(DISTINCT "{c}") < count(*) * 0.5 FROM orders""",
        ORDER_TEXTS,
    )
    + " UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', false",
)
def narrowing_plan(spark, folder):
    return readers.narrowing_plan(table(spark, folder, "orders"))


@query(
    "narrowed_table",
    """SELECT o_custkey, count(*) AS orders, sum(o_orderkey)::BIGINT AS key_sum, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_custkey""",
)
def narrowed_table(spark, folder):
    df = readers.narrow_types(table(spark, folder, "orders"))
    out = df.groupBy(F.col("o_custkey").cast("long").alias("o_custkey")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("o_orderkey").cast("long")).alias("key_sum"),
        F.sum("o_totalprice").alias("total"),
    )
    return rounded(out, 2)


@query(
    "clean_column_names",
    """SELECT p_brand AS part_brand, p_size AS part_size_cm, count(*) AS row_count FROM part GROUP BY 1, 2""",
)
def clean_column_names(spark, folder):
    messy = table(spark, folder, "part").select(
        F.col("p_brand").alias(" Part  Brand "), F.col("p_size").alias("Part-Size (cm)")
    )
    clean = readers.clean_column_names(messy)
    return clean.groupBy(*clean.columns).agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "date_promotion",
    """SELECT year(o_orderdate)::INT AS y, count(*) AS orders, min(o_orderdate)::DATE AS first_day FROM orders
       GROUP BY 1""",
)
def date_promotion(spark, folder):
    text = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority"
    )
    promoted = readers.promote_dates(text)
    return promoted.groupBy(F.year("day").alias("y")).agg(
        F.count(F.lit(1)).alias("orders"), F.to_date(F.min("day")).alias("first_day")
    )


@query(
    "date_shares",
    union_all(
        """SELECT '{c}' AS "column", count("{c}") AS non_null, count(try_cast("{c}" AS TIMESTAMP)) AS parsed,
           round(count(try_cast("{c}" AS TIMESTAMP)) / count("{c}"), 6) AS share FROM orders""",
        ORDER_TEXTS,
    ),
)
def date_shares(spark, folder):
    return rounded(readers.date_shares(table(spark, folder, "orders"), ORDER_TEXTS))


@query(
    "integrity_checks",
    f"""WITH s AS (SELECT count(*) AS n, {' + '.join(f'count(*) - count({c})' for c in EVENT_COLUMNS)} AS missing
        FROM events)
    SELECT unnest(['has_rows', 'has_columns', 'all_null_columns', 'completeness_percent', 'numeric_columns',
                   'categorical_columns', 'datetime_columns']) AS "check",
           unnest(['success', 'success', 'success', 'success', 'success', 'success', 'success']) AS status,
           unnest([n::VARCHAR, '6', '', round((1 - missing / (n * 6)) * 100, 1)::VARCHAR, '3', '2', '1']) AS detail
    FROM s""",
)
def integrity_checks(spark, folder):
    return readers.verify_integrity(table(spark, folder, "events"))


@query(
    "expectation_checks",
    """SELECT 'expected_columns' AS "check", 'eff_day' AS subject, 'warning' AS status, 1.0::DOUBLE AS value
    UNION ALL SELECT 'max_value', 'l_extendedprice', CASE WHEN max(l_extendedprice) > 50000 THEN 'warning'
      ELSE 'success' END, max(l_extendedprice) FROM lineitem
    UNION ALL SELECT 'max_distinct', 'l_returnflag', CASE WHEN count(DISTINCT l_returnflag) > 60 THEN 'warning'
      ELSE 'success' END, count(DISTINCT l_returnflag)::DOUBLE FROM lineitem""",
)
def expectation_checks(spark, folder):
    return readers.verify_expectations(
        table(spark, folder, "lineitem"),
        ["l_quantity", "eff_day"],
        {"l_extendedprice": 50_000.0},
        {"l_returnflag": 60},
    )


# --- filters ---------------------------------------------------------------------

STEPS = [
    {"column": "l_quantity", "operator": "greater_than", "value": 5},
    {"column": "l_returnflag", "operator": "not_equals", "value": "R"},
    {"column": "no_such_column", "operator": "equals", "value": 1},
    {"column": "l_discount", "operator": "less_than", "value": 0.08},
    {"column": "l_linestatus", "operator": "isin", "value": ["O", "F"]},
    {"column": "l_returnflag", "operator": "contains", "value": "^[AN]$"},
]
_P = [
    "l_quantity > 5",
    "l_returnflag IS DISTINCT FROM 'R'",
    "l_discount < 0.08",
    "l_linestatus IN ('O', 'F')",
    "regexp_matches(l_returnflag, '^[AN]$')",
]
_STEP_NAMES = [(s["column"], s["operator"]) for s in STEPS if s["column"] != "no_such_column"]


@query(
    "filter_accounting",
    "WITH s AS (SELECT count(*) AS n0, "
    + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(_P[: i + 1])}) AS n{i + 1}" for i in range(len(_P)))
    + " FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT {i + 1} AS step, '{c}' AS "column", '{o}' AS operator, n{i} AS rows_before, n{i + 1} AS rows_after,
            n{i} - n{i + 1} AS rows_filtered, round((n0 - n{i + 1}) / n0 * 100, 6) AS reduction_pct FROM s"""
        for i, (c, o) in enumerate(_STEP_NAMES)
    ),
)
def filter_accounting(spark, folder):
    return rounded(filters.filter_accounting(table(spark, folder, "lineitem"), STEPS))


@query(
    "filter_rows",
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE {' AND '.join(_P)}",
)
def filter_rows(spark, folder):
    kept = filters.apply_filters(table(spark, folder, "lineitem"), STEPS)
    return kept.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "filter_merged_equals",
    """SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderstatus IN ('F', 'O')
       AND o_totalprice >= 100000 GROUP BY 1""",
)
def filter_merged_equals(spark, folder):
    specs = [
        {"column": "status", "operator": "equals", "value": "F"},
        {"column": "status", "operator": "equals", "value": "O"},
        {"column": "price", "operator": "greater_equal", "value": "100000"},
    ]
    names = {"status": "o_orderstatus", "price": "o_totalprice"}
    kept = filters.apply_filters(
        table(spark, folder, "orders"), specs, aliases=names, coerce=True, any_of_equals=True
    )
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "filter_contains_ignoring_case",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urgent|LOW')",
)
def filter_contains_ignoring_case(spark, folder):
    spec = [{"column": "o_orderpriority", "operator": "contains", "value": "urgent|low"}]
    kept = filters.apply_filters(table(spark, folder, "orders"), spec, ignore_case=True)
    return kept.select("o_orderkey", "o_orderpriority")


@query(
    "filter_tiered_equals",
    """SELECT c_mktsegment, count(*) AS customers FROM customer
    WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = 'AUTOMOBILE' OR contains(c_mktsegment, 'HOUSE') GROUP BY 1""",
)
def filter_tiered_equals(spark, folder):
    customers = table(spark, folder, "customer")
    exact = filters.tiered_equals(customers, "c_mktsegment", "building")
    by_name = filters.tiered_equals(customers, "c_mktsegment", "cars", names={"cars": "AUTOMOBILE"})
    partial = filters.tiered_equals(customers, "c_mktsegment", "house")
    found = exact.union(by_name).union(partial)
    return found.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "filter_on_empty",
    """SELECT 'partial' AS mode, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, '(?i)high')
    UNION ALL SELECT 'full', count(*) FROM orders UNION ALL SELECT 'empty', 0""",
)
def filter_on_empty(spark, folder):
    orders = table(spark, folder, "orders")
    out = None
    for mode in ("partial", "full", "empty"):
        kept = filters.apply_filters(orders, {"o_orderpriority": "high"}, on_empty=mode)
        row = kept.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


@query(
    "filter_top_values",
    """WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)
    SELECT p_brand, count(*) AS parts FROM part WHERE p_brand IN (SELECT p_brand FROM top) GROUP BY 1""",
)
def filter_top_values(spark, folder):
    kept = filters.filter_top_values(table(spark, folder, "part"), "p_brand", 5)
    return kept.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))


@query(
    "filter_preset",
    """WITH c AS (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4),
    r AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)
    SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem
    WHERE l_returnflag IN (SELECT * FROM c) AND l_suppkey IN (SELECT * FROM r) AND l_quantity > 0 GROUP BY 1, 2""",
)
def filter_preset(spark, folder):
    roles = {"region": "l_suppkey", "category": "l_returnflag"}
    kept = filters.preset_filter(
        table(spark, folder, "lineitem"), ["state", "category", "volume"], roles, quantity="l_quantity"
    )
    return kept.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


# --- derived columns -------------------------------------------------------------


@query(
    "calendar_columns",
    """SELECT month(l_shipdate)::INT AS month, quarter(l_shipdate)::INT AS quarter, year(l_shipdate)::INT AS year,
       (isodow(l_shipdate) - 1)::INT AS day_of_week, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def calendar_columns(spark, folder):
    df = derive.calendar_columns(table(spark, folder, "lineitem"), "l_shipdate")
    return df.groupBy("month", "quarter", "year", "day_of_week").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clock_columns",
    """SELECT hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, day(ts)::INT AS day_of_month,
       month(ts)::INT AS month, count(*) AS n FROM events GROUP BY 1, 2, 3, 4""",
)
def clock_columns(spark, folder):
    df = derive.clock_columns(table(spark, folder, "events"), "ts")
    return df.groupBy("hour", "day_of_week", "day_of_month", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flow_flags",
    """SELECT value > 0 AS has_quantity, sign(c_acctbal) = 1 AS is_receipt, sign(c_acctbal) = -1 AS is_delivery,
       count(*) AS n FROM (SELECT c_acctbal, c_acctbal AS value FROM customer) GROUP BY 1, 2, 3""",
)
def flow_flags(spark, folder):
    df = table(spark, folder, "customer").withColumn("sign", F.signum("c_acctbal"))
    flagged = derive.flow_flags(df, "c_acctbal", "sign")
    return flagged.groupBy("has_quantity", "is_receipt", "is_delivery").agg(F.count(F.lit(1)).alias("n"))


@query(
    "domain_preparation",
    """SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, o_totalprice > 0 AS has_quantity,
       count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2, 3""",
)
def domain_preparation(spark, folder):
    df = table(spark, folder, "orders").withColumns(
        {"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "price": F.col("o_totalprice").cast("string")}
    )
    ready = derive.prepare_domain_table(df, "day", "o_totalprice", "no_sign", ["price"])
    out = ready.groupBy("year", "quarter", "has_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")
    )
    return rounded(out, 2)


@query(
    "rank_encoding",
    """SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 99 END AS status_rank,
       count(*) AS n FROM orders GROUP BY 1, 2""",
)
def rank_encoding(spark, folder):
    df = derive.rank_encode(table(spark, folder, "orders"), "o_orderstatus", ["O", "F"], "status_rank")
    return df.groupBy("o_orderstatus", "status_rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "clustering_features",
    """SELECT month(l_shipdate)::INT AS month, round(avg(ln(1 + coalesce(l_quantity, 0))), 6) AS log_quantity,
       sum((l_linestatus = 'O')::INT)::BIGINT AS open_rows FROM lineitem GROUP BY 1""",
)
def clustering_features(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_quantity", F.month("l_shipdate").alias("month"), (F.col("l_linestatus") == "O").alias("open")
    )
    features = derive.clustering_features(df, "l_quantity", flags=["open"])
    out = features.groupBy("month").agg(
        F.avg("log_quantity").alias("log_quantity"), F.sum("open_flag").alias("open_rows")
    )
    return rounded(out)


@query(
    "clip_to_quantiles",
    """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi
       FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_extendedprice, lo), hi), 4) AS l_extendedprice
    FROM lineitem, b""",
)
def clip_to_quantiles(spark, folder):
    df = derive.clip_to_quantiles(table(spark, folder, "lineitem"), ["l_extendedprice"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 4)


@query(
    "standard_scaling",
    """SELECT l_orderkey, l_linenumber, l_partkey,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem""",
)
def standard_scaling(spark, folder):
    df = derive.standard_scale(table(spark, folder, "lineitem"), ["l_quantity"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))


@query(
    "robust_scaling",
    """WITH b AS (SELECT median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75)
         - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / iqr, 6) AS l_extendedprice
    FROM lineitem, b""",
)
def robust_scaling(spark, folder):
    df = derive.robust_scale(table(spark, folder, "lineitem"), ["l_extendedprice"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))


@query(
    "feature_choice",
    """SELECT unnest(['quantity', 'latitude']) AS feature, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity
    FROM lineitem""",
)
def feature_choice(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("latitude"), "l_discount"
    )
    chosen = derive.choose_features(df)
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg("quantity").alias("mean_quantity"))
    return rounded(out.select(F.explode(F.array(*[F.lit(c) for c in chosen])).alias("feature"), "n", "mean_quantity"))


# --- aggregation -----------------------------------------------------------------


@query(
    "aggregate_two_keys",
    """SELECT l_returnflag, l_linestatus, count(l_quantity) AS "count", round(avg(l_quantity), 6) AS mean,
       median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min,
       max(l_quantity) AS max, sum(l_quantity) AS sum FROM lineitem GROUP BY 1, 2""",
)
def aggregate_two_keys(spark, folder):
    functions = [*agg.DEFAULT_FUNCTIONS, "sum"]
    out = agg.aggregate(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", functions)
    return rounded(out)


@query(
    "top_values",
    """SELECT p_brand AS value, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_values(spark, folder):
    return agg.top_values(table(spark, folder, "part"), "p_brand")


@query(
    "count_analysis",
    """WITH f AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1)
    SELECT sum(n)::BIGINT AS total_count, (sum(n) FILTER (WHERE v IS NOT NULL))::BIGINT AS non_null_count,
      coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS null_count, count(v) AS unique_count,
      (SELECT v FROM f ORDER BY n DESC, v LIMIT 1) AS most_frequent, max(n) AS most_frequent_count,
      (SELECT v FROM f ORDER BY n, v DESC LIMIT 1) AS least_frequent, min(n) AS least_frequent_count FROM f""",
)
def count_analysis(spark, folder):
    return agg.count_analysis(table(spark, folder, "part"), "p_brand")


@query(
    "crosstab",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS "count" FROM orders GROUP BY 1, 2""",
)
def crosstab(spark, folder):
    return agg.crosstab(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "duplicate_rows",
    """SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM
    (SELECT count(*) AS n FROM (SELECT l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem)
     GROUP BY l_quantity, l_discount, l_returnflag, l_linestatus)""",
)
def duplicate_rows(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return agg.duplicate_rows(df)


@query(
    "duplicate_documents",
    """SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM
    (SELECT count(*) AS n FROM documents GROUP BY text, lang)""",
)
def duplicate_documents(spark, folder):
    return agg.duplicate_rows(table(spark, folder, "documents").select("text", "lang"))


@query(
    "distinct_counts",
    union_all(
        """SELECT '{c}' AS "column", count(DISTINCT "{c}") AS distinct_values FROM lineitem""", LINE_COLUMNS
    ),
)
def distinct_counts(spark, folder):
    return agg.distinct_counts(table(spark, folder, "lineitem"), LINE_COLUMNS)


@query("group_sizes", "SELECT event_type, count(*) AS size FROM events GROUP BY 1")
def group_sizes(spark, folder):
    return agg.group_sizes(table(spark, folder, "events"), "event_type")


@query(
    "robust_statistics",
    union_all(
        """SELECT l_returnflag, '{c}' AS "column", round(m, 6) AS median, round(a, 6) AS q25, round(b, 6) AS q75,
        round(b - a, 6) AS iqr, round(median(abs(x - m)), 6) AS mad, round(median(abs(x - m)) / m, 6) AS robust_cv,
        round(a - 1.5 * (b - a), 6) AS lower_fence, round(b + 1.5 * (b - a), 6) AS upper_fence
        FROM (SELECT l_returnflag, {c} AS x FROM lineitem) JOIN (SELECT l_returnflag, median({c}) AS m,
          quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem GROUP BY 1)
        USING (l_returnflag) GROUP BY l_returnflag, m, a, b""",
        ["l_quantity", "l_extendedprice"],
    ),
)
def robust_statistics(spark, folder):
    return rounded(
        agg.robust_statistics(table(spark, folder, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    )


# --- description and profile -----------------------------------------------------


@query(
    "overview",
    f"""SELECT count(*) AS total_rows, 6 AS total_columns, 3 AS numeric_columns, 2 AS categorical_columns,
    1 AS datetime_columns, (sum({' + '.join(f'({c} IS NULL)::INT' for c in EVENT_COLUMNS)}))::BIGINT AS missing_cells,
    round((1 - sum({' + '.join(f'({c} IS NULL)::INT' for c in EVENT_COLUMNS)}) / (count(*) * 6)) * 100, 6)
      AS completeness_score,
    (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicate_rows
    FROM events""",
)
def overview(spark, folder):
    return rounded(describe.overview(table(spark, folder, "events")))


@query(
    "describe_numeric",
    union_all(
        """SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 7) AS mean,
        round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
        round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
        round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median
        FROM lineitem""",
        LINE_NUMBERS,
    ),
)
def describe_numeric(spark, folder):
    return rounded(describe.describe_numeric(table(spark, folder, "lineitem")), 6, mean=7)


_TOP = """(SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_TOPN = """(SELECT count(*) FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1)"""


@query(
    "describe_categorical",
    union_all(
        f"""SELECT '{{c}}' AS "column", count({{c}}) AS "count", count(DISTINCT {{c}}) AS "unique", {_TOP} AS top_value,
        {_TOPN} AS top_freq, round(count(DISTINCT {{c}}) / count(*), 8) AS cardinality_ratio FROM orders""",
        ORDER_TEXTS,
    ),
)
def describe_categorical(spark, folder):
    return rounded(describe.describe_categorical(table(spark, folder, "orders")), 8)


@query(
    "describe_datetime",
    """SELECT 'ts' AS "column", count(ts) AS "count", min(ts) AS min_date, max(ts) AS max_date,
    floor(epoch(max(ts) - min(ts)) / 86400)::BIGINT AS range_days, count(DISTINCT ts) AS unique_dates FROM events""",
)
def describe_datetime(spark, folder):
    return describe.describe_datetime(table(spark, folder, "events"))


_SPARSE = """(SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey,
  CASE WHEN c_acctbal < 2000 THEN NULL ELSE c_acctbal END AS c_acctbal,
  nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer)"""
_SPARSE_COLUMNS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]


def sparse_customers(spark, folder):
    """Customers with some values blanked by rule, so that missing-data queries have work."""
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"),
        F.when(F.col("c_acctbal") >= 2000, F.col("c_acctbal")).alias("c_acctbal"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
    )


@query(
    "missing_by_column",
    union_all(
        f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS missing,
        round((count(*) - count({{c}})) / count(*) * 100, 6) AS missing_pct FROM {_SPARSE}""",
        _SPARSE_COLUMNS,
    ),
)
def missing_by_column(spark, folder):
    return rounded(describe.missing_by_column(sparse_customers(spark, folder)))


@query(
    "missing_summary",
    f"""WITH m AS ({union_all(f'''SELECT '{{c}}' AS col, count(*) - count({{c}}) AS missing, count(*) AS n FROM {_SPARSE}''', _SPARSE_COLUMNS)})
    SELECT sum(missing)::BIGINT AS total_missing, count(*) FILTER (WHERE missing > 0) AS columns_with_missing,
    arg_max(col, missing) AS most_missing_column, round(max(missing / n * 100), 6) AS most_missing_percentage FROM m""",
)
def missing_summary(spark, folder):
    return rounded(describe.missing_summary(sparse_customers(spark, folder)))


@query(
    "column_profile",
    union_all(
        """SELECT '{c}' AS "column", CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
        WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS dtype, count(*) AS "count",
        count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) / count(*) * 100, 6) AS null_percentage, count(DISTINCT {c}) AS unique_count,
        round(count(DISTINCT {c}) / count(*) * 100, 6) AS unique_percentage FROM events""",
        EVENT_COLUMNS,
    ),
)
def column_profile(spark, folder):
    return rounded(profile.column_profile(table(spark, folder, "events")))


def _semantic(column: str, group: str) -> str:
    named = any(w in column for w in profile.ID_WORDS)
    kinds = {
        "numeric": """CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) <= 2 THEN 'boolean_numeric'
            WHEN count(DISTINCT {c}) < count(*) * 0.05 THEN 'categorical_numeric' ELSE 'continuous_numeric' END""",
        "text": f"""CASE WHEN count({{c}}) = 0 THEN 'empty'
            WHEN count(try_cast({{c}} AS TIMESTAMP)) > count({{c}}) * 0.8 THEN 'date_string'
            WHEN {str(named).lower()} OR count(DISTINCT {{c}}) = count({{c}}) THEN 'identifier'
            WHEN count(DISTINCT {{c}}) < count({{c}}) * 0.5 THEN 'categorical' ELSE 'text' END""",
    }
    return f"""SELECT '{column}' AS "column", {kinds[group].replace('{c}', column)} AS semantic_type, count(*) AS rows,
        count({column}) AS non_null, count(DISTINCT {column}) AS distinct_values FROM part"""


@query(
    "semantic_types",
    " UNION ALL ".join(
        _semantic(c, "text" if c in ("p_name", "p_brand", "p_type") else "numeric") for c in PART_COLUMNS
    ),
)
def semantic_types(spark, folder):
    return profile.semantic_types(table(spark, folder, "part"))


@query(
    "schema_info",
    "WITH s AS (" + " UNION ALL ".join(
        _semantic(c, "text" if c in ("p_name", "p_brand", "p_type") else "numeric") for c in PART_COLUMNS
    ) + """) SELECT list_position(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'], "column") - 1
      AS position, "column", CASE "column" WHEN 'p_partkey' THEN 'bigint' WHEN 'p_size' THEN 'int'
      WHEN 'p_retailprice' THEN 'double' ELSE 'string' END AS dtype,
      CASE WHEN "column" IN ('p_partkey', 'p_size', 'p_retailprice') THEN 'numeric' ELSE 'categorical' END AS type_group,
      semantic_type, rows - non_null AS missing, round((rows - non_null) / rows * 100, 2) AS missing_pct FROM s""",
)
def schema_info(spark, folder):
    return profile.schema_info(table(spark, folder, "part"))


@query(
    "detect_issues",
    """WITH d AS (SELECT CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS rich, 'x' AS same, c_mktsegment AS segment
      FROM customer),
    n AS (SELECT count(*) AS rows, (1 - count(rich) / count(*)) * 100 AS pct FROM d),
    u AS (SELECT count(*) AS kinds FROM (SELECT DISTINCT * FROM d))
    SELECT 'high_missing_values' AS type, 'rich' AS "column", CASE WHEN pct > 80 THEN 'high' ELSE 'medium' END AS severity,
      printf('%.1f%% of the values of ''rich'' are missing', pct) AS description FROM n WHERE pct > 50
    UNION ALL SELECT 'constant_column', 'same', 'medium', '''same'' holds the same value everywhere'
    UNION ALL SELECT 'duplicate_rows', NULL, CASE WHEN (rows - kinds) / rows * 100 > 10 THEN 'high' ELSE 'medium' END,
      printf('%d rows (%.1f%%) repeat another one', rows - kinds, (rows - kinds) / rows * 100) FROM n, u WHERE rows > kinds""",
)
def detect_issues(spark, folder):
    df = table(spark, folder, "customer").select(
        F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).alias("rich"),
        F.lit("x").alias("same"),
        F.col("c_mktsegment").alias("segment"),
    )
    return profile.detect_issues(df)


_FENCE = "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"


@query(
    "numeric_profile",
    union_all(
        """SELECT '{c}' AS "column", count({c}) AS "count", min({c}) AS min, max({c}) AS max, round(avg({c}), 5) AS mean,
        round(stddev_samp({c}), 5) AS std, round(var_samp({c}), 2) AS var, round(skewness({c}), 5) AS skewness,
        round(kurtosis({c}), 5) AS kurtosis, round(max({c}) - min({c}), 5) AS range,
        count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} < 0) AS negative_count,
        count(*) FILTER (WHERE {c} > 0) AS positive_count, round(quantile_cont({c}, 0.01), 5) AS q_1,
        round(quantile_cont({c}, 0.05), 5) AS q_5, round(quantile_cont({c}, 0.25), 5) AS q_25,
        round(median({c}), 5) AS median, round(quantile_cont({c}, 0.75), 5) AS q_75,
        round(quantile_cont({c}, 0.95), 5) AS q_95, round(quantile_cont({c}, 0.99), 5) AS q_99,
        any_value(o) AS outlier_count, round(any_value(o) / count({c}) * 100, 5) AS outlier_percentage,
        CASE WHEN any_value(b > a) THEN round(any_value(a - 1.5 * (b - a)), 5) END AS fence_low,
        CASE WHEN any_value(b > a) THEN round(any_value(b + 1.5 * (b - a)), 5) END AS fence_high
        FROM lineitem, (SELECT a, b, CASE WHEN b > a THEN (SELECT count(*) FROM lineitem
            WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) ELSE 0 END AS o FROM
          (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem))""",
        MEASURES,
    ),
)
def numeric_profile(spark, folder):
    return rounded(profile.numeric_profile(table(spark, folder, "lineitem"), MEASURES), 5, var=2)


@query(
    "categorical_profile",
    union_all(
        """SELECT '{c}' AS "column", (SELECT {c} FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY {c})) AS most_frequent_count,
        (SELECT {c} FROM part GROUP BY 1 ORDER BY count(*), 1 DESC LIMIT 1) AS least_frequent,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM part GROUP BY {c})) AS least_frequent_count,
        count(DISTINCT {c}) AS cardinality, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length,
        round(avg(length({c})), 6) AS avg_length, median(length({c})::DOUBLE) AS median_length FROM part""",
        ["p_name", "p_brand", "p_type"],
    ),
)
def categorical_profile(spark, folder):
    return rounded(profile.categorical_profile(table(spark, folder, "part")))


@query(
    "document_text_profile",
    union_all(
        """SELECT '{c}' AS "column", (SELECT {c} FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM documents GROUP BY {c})) AS most_frequent_count,
        (SELECT {c} FROM documents GROUP BY 1 ORDER BY count(*), 1 DESC LIMIT 1) AS least_frequent,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY {c})) AS least_frequent_count,
        count(DISTINCT {c}) AS cardinality, min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length,
        round(avg(length({c})), 6) AS avg_length, median(length({c})::DOUBLE) AS median_length FROM documents""",
        ["text", "lang", "source"],
    ),
)
def document_text_profile(spark, folder):
    return rounded(profile.categorical_profile(table(spark, folder, "documents")))


@query(
    "top_categories",
    union_all(
        """SELECT '{c}' AS "column", row_number() OVER (ORDER BY n DESC, v)::INT AS rank, v AS value, n AS "count"
        FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1) QUALIFY rank <= 10""",
        ["p_name", "p_brand", "p_type"],
    ),
)
def top_categories(spark, folder):
    return profile.top_categories(table(spark, folder, "part"))


@query(
    "document_top_categories",
    union_all(
        """SELECT '{c}' AS "column", row_number() OVER (ORDER BY n DESC, v)::INT AS rank, v AS value, n AS "count"
        FROM (SELECT {c} AS v, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY rank <= 10""",
        ["text", "lang", "source"],
    ),
)
def document_top_categories(spark, folder):
    """Whole texts among the values: only digests are shuffled, the winners are looked up."""
    return profile.top_categories(table(spark, folder, "documents"))


@query(
    "document_categories",
    union_all(
        """SELECT '{c}' AS "column", count({c}) AS "count", count(DISTINCT {c}) AS "unique",
        (SELECT {c} FROM documents WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value,
        (SELECT max(n) FROM (SELECT count({c}) AS n FROM documents GROUP BY {c})) AS top_freq,
        round(count(DISTINCT {c}) / count(*), 6) AS cardinality_ratio FROM documents""",
        ["text", "lang", "source"],
    ),
)
def document_categories(spark, folder):
    return rounded(describe.describe_categorical(table(spark, folder, "documents")))


@query(
    "datetime_profile",
    """WITH d AS (SELECT DISTINCT o_orderdate AS m FROM orders),
    s AS (SELECT date_diff('second', lag(m) OVER (ORDER BY m), m) AS step FROM d)
    SELECT 'o_orderdate' AS "column", (SELECT count(o_orderdate) FROM orders) AS "count", min(m) AS min_date,
    max(m) AS max_date, date_diff('day', min(m), max(m)) AS date_range_days,
    (SELECT CASE WHEN min(step) = max(step) THEN min(step) END FROM s) AS step_seconds,
    NULL::BIGINT AS month_step FROM d""",
)
def datetime_profile(spark, folder):
    return profile.datetime_profile(table(spark, folder, "orders"), "o_orderdate")


@query(
    "datetime_month_step",
    """SELECT 'month' AS "column", count(*) AS "count", min(date_trunc('month', o_orderdate))::TIMESTAMP AS min_date,
    max(date_trunc('month', o_orderdate))::TIMESTAMP AS max_date,
    date_diff('day', min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate))) AS date_range_days,
    NULL::BIGINT AS step_seconds, 1::BIGINT AS month_step FROM orders""",
)
def datetime_month_step(spark, folder):
    months = table(spark, folder, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    )
    return profile.datetime_profile(months, "month")


@query(
    "correlation_summary",
    """WITH n AS (SELECT o_orderkey, o_totalprice, o_totalprice + 100000 * (o_custkey % 7) AS noisy FROM orders),
    p AS (SELECT 'o_orderkey' AS column1, 'noisy' AS column2, corr(o_orderkey, noisy) AS r FROM n
      UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM n
      UNION ALL SELECT 'o_totalprice', 'noisy', corr(o_totalprice, noisy) FROM n)
    SELECT column1, column2, round(r, 6) AS correlation, CASE WHEN abs(r) > 0.8 THEN 'strong' ELSE 'moderate' END
    AS strength FROM p WHERE abs(r) > 0.5""",
)
def correlation_summary(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") + 100000 * (F.col("o_custkey") % 7)).alias("noisy")
    )
    return rounded(profile.correlation_summary(df))


@query(
    "uniformity",
    union_all(
        """SELECT '{c}' AS "column", count({c}) AS "count",
        round(abs(stddev_samp({c}) - (max({c}) - min({c})) / sqrt(12)) / ((max({c}) - min({c})) / sqrt(12)), 6)
          AS deviation_gap,
        abs(stddev_samp({c}) - (max({c}) - min({c})) / sqrt(12)) / ((max({c}) - min({c})) / sqrt(12)) < 0.2 AS is_uniform
        FROM lineitem""",
        MEASURES,
    ),
)
def uniformity(spark, folder):
    return rounded(profile.uniformity(table(spark, folder, "lineitem"), MEASURES))


@query(
    "histogram",
    union_all(
        """SELECT '{c}' AS "column", bin, round(lo + bin * (hi - lo) / k, 6) AS bin_start,
        CASE WHEN bin = k - 1 THEN hi ELSE round(lo + (bin + 1) * ((hi - lo) / k), 6) END AS bin_end,
        (SELECT count(*) FROM lineitem WHERE least(floor(({c} - lo) / ((hi - lo) / k)), k - 1) = bin) AS "count"
        FROM (SELECT lo, hi, k, unnest(range(k))::INT AS bin FROM (SELECT min({c}) AS lo, max({c}) AS hi,
          least(20, count(DISTINCT {c})) AS k FROM lineitem))""",
        ["l_extendedprice", "l_quantity"],
    ),
)
def histogram(spark, folder):
    out = profile.histogram(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(out)


@query(
    "value_patterns",
    """SELECT "column", pattern_type, NULL::VARCHAR AS detail, NULL::DOUBLE AS measure FROM (
      SELECT 'value' AS "column", 'integer_values' AS pattern_type, bool_and(value = round(value)) AS hit FROM events
      UNION ALL SELECT 'event_id', 'integer_values', true UNION ALL SELECT 'user_id', 'integer_values', true
      UNION ALL SELECT 'value', 'non_negative', bool_and(value >= 0) FROM events
      UNION ALL SELECT 'event_id', 'non_negative', bool_and(event_id >= 0) FROM events
      UNION ALL SELECT 'user_id', 'non_negative', bool_and(user_id >= 0) FROM events) WHERE hit
    UNION ALL SELECT 'props', 'dominant_category', v, round(share, 6) FROM (SELECT props AS v,
      count(*) / sum(count(*)) OVER () * 100 AS share FROM events GROUP BY 1) WHERE share > 80
    UNION ALL SELECT 'event_type', 'dominant_category', v, round(share, 6) FROM (SELECT event_type AS v,
      count(*) / sum(count(*)) OVER () * 100 AS share FROM events GROUP BY 1) WHERE share > 80
    UNION ALL SELECT 'ts', 'temporal', NULL, floor(epoch(max(ts) - min(ts)) / 86400) FROM events""",
)
def value_patterns(spark, folder):
    return rounded(profile.value_patterns(table(spark, folder, "events")))


@query(
    "numeric_by_category",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS category_column, {c} AS category, '{n}' AS numeric_column, count({n}) AS "count",
        round(avg({n}), 5) AS mean, round(coalesce(stddev_samp({n}), 0), 5) AS std FROM part GROUP BY {c}"""
        for c in ("p_brand", "p_type")
        for n in ("p_size", "p_retailprice")
    ),
)
def numeric_by_category(spark, folder):
    out = profile.numeric_by_category(
        table(spark, folder, "part"), ["p_size", "p_retailprice"], ["p_brand", "p_type"]
    )
    return rounded(out, 5)


@query(
    "profile_summary",
    f"""WITH p AS ({union_all(f'''SELECT count(*) AS n, count(*) - count({{c}}) AS m, count(DISTINCT {{c}}) AS d FROM {_SPARSE}''', _SPARSE_COLUMNS)})
    SELECT count(*) FILTER (WHERE m > 0) AS columns_with_missing, sum(m)::BIGINT AS total_missing_cells,
    round(sum(m) / sum(n) * 100, 6) AS missing_percentage, count(*) FILTER (WHERE d > n * 0.9) AS highly_unique_columns,
    count(*) FILTER (WHERE d < 10) AS low_cardinality_columns FROM p""",
)
def profile_summary(spark, folder):
    return rounded(profile.profile_summary(sparse_customers(spark, folder)))


@query("table_fingerprint")
def table_fingerprint(spark, folder):
    return profile.table_fingerprint(table(spark, folder, "lineitem"))


def _written(spark, suffix: str) -> str:
    """A new path for a table in the folder every executor reaches."""
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}.{suffix}"


_ORDERS = """SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
    o_orderstatus, o_orderpriority FROM orders"""


def _as_orders(df):
    """Orders with the types of the given table and the time as text."""
    return df.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), F.col("o_totalprice").cast("double"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderstatus", "o_orderpriority",
    )


@query("parquet_round_trip", _ORDERS)
def parquet_round_trip(spark, folder):
    path = _written(spark, "parquet")
    readers.write_table(table(spark, folder, "orders"), path, partition_by=["o_orderstatus"])
    return _as_orders(readers.read_table(spark, path))


@query("csv_round_trip", _ORDERS)
def csv_round_trip(spark, folder):
    """Types and dates are found again from the text."""
    path = _written(spark, "csv")
    table(spark, folder, "orders").write.csv(path, header=True, quote='"', escape='"')
    found = readers.read_table(spark, path)
    assert dict(found.dtypes)["o_orderdate"] == "timestamp"
    return _as_orders(found)


@query("json_round_trip", _ORDERS)
def json_round_trip(spark, folder):
    path = _written(spark, "json")
    table(spark, folder, "orders").write.json(path)
    found = readers.read_table(spark, path, json_lines=True)
    assert dict(found.dtypes)["o_orderdate"] == "timestamp"
    return _as_orders(found)
