"""Queries: data quality and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.basics import _SPARSE, _SPARSE_COLUMNS, sparse_customers
from tidemark.catalog.registry import query, rounded, table, union_all
from tidemark.operators import cleaning, quality

_CELLS = union_all(
    f"SELECT '{{c}}' AS col, count(*) AS n, count(*) - count({{c}}) AS m, count(DISTINCT {{c}}) AS d FROM {_SPARSE}",
    _SPARSE_COLUMNS,
)


@query(
    "column_quality",
    f"""WITH p AS ({_CELLS}) SELECT col AS "column", round(m / n * 100, 2) AS missing_percentage,
    round(100 - m / n * 100, 2) AS quality_score, CASE col WHEN 'c_custkey' THEN 'bigint' WHEN 'c_nationkey' THEN 'int'
    WHEN 'c_acctbal' THEN 'double' ELSE 'string' END AS data_type, d AS unique_values, m AS null_count FROM p""",
)
def column_quality(spark, folder):
    return quality.column_quality(sparse_customers(spark, folder))


@query(
    "completeness",
    f"""WITH p AS ({_CELLS}) SELECT round(sum(n - m) / sum(n) * 100, 2) AS completeness_score,
    sum(m)::BIGINT AS total_missing_cells, round(sum(m) / sum(n) * 100, 2) AS missing_percentage,
    count(*) FILTER (WHERE m > 0) AS columns_with_missing,
    count(*) FILTER (WHERE round(m / n * 100, 2) > 80) AS columns_mostly_missing FROM p""",
)
def completeness(spark, folder):
    return quality.completeness(sparse_customers(spark, folder))


_MARKED = " OR ".join(f"contains({{c}}, '{m}')" for m in quality.DATE_MARKS)
_FORMAT = """CASE WHEN len(string_split(trim({c}), '/')) = 3 THEN 1 WHEN len(string_split(trim({c}), '-')) = 3 THEN 2
  WHEN contains(trim({c}), 'T') THEN 3 WHEN contains(trim({c}), ':') THEN 4 END"""
_CONSISTENCY = union_all(
    f"""SELECT 'consistency' AS aspect, 'mixed_types' AS type, '{{c}}' AS "column", k AS "count",
      round(k / n * 100, 2) AS percentage FROM (SELECT count({{c}}) AS n,
      count(*) FILTER (WHERE regexp_matches({{c}}, '^-?\\d+\\.?\\d*$')) AS k FROM {{t}}) WHERE k > 0 AND k < n
    UNION ALL SELECT 'consistency', 'inconsistent_date_formats', '{{c}}', f, NULL FROM (SELECT count({{c}}) AS n,
      count(*) FILTER (WHERE {_MARKED}) AS k, count(DISTINCT {_FORMAT}) AS f FROM {{t}}) WHERE k > n * 0.5 AND f > 1
    UNION ALL SELECT 'consistency', 'case_inconsistency', '{{c}}', bad, NULL FROM (SELECT count(*) AS keys,
      count(*) FILTER (WHERE v > 1) AS bad FROM (SELECT count(DISTINCT {{c}}) AS v FROM {{t}} WHERE {{c}} IS NOT NULL
      GROUP BY lower({{c}}))) WHERE bad > 0 AND bad < keys * 0.5""",
    ["{c}"],
)

_MESSY = """(SELECT CASE WHEN l_linenumber = 1 THEN (l_quantity::INT)::VARCHAR ELSE l_returnflag END AS mixed,
  CASE WHEN l_linenumber <= 3 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE strftime(l_shipdate, '%m/%d/%Y') END AS day,
  CASE WHEN l_orderkey % 50 = 0 THEN lower(l_returnflag) ELSE l_returnflag END || '-' || (l_partkey % 40) AS code
  FROM lineitem)"""


def messy_lines(spark, folder):
    line = table(spark, folder, "lineitem")
    flag = F.when(F.col("l_orderkey") % 50 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag"))
    return line.select(
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("int").cast("string"))
        .otherwise(F.col("l_returnflag"))
        .alias("mixed"),
        F.when(F.col("l_linenumber") <= 3, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("l_shipdate", "MM/dd/yyyy"))
        .alias("day"),
        F.concat(flag, F.lit("-"), (F.col("l_partkey") % 40).cast("string")).alias("code"),
    )


@query(
    "consistency_findings",
    "\nUNION ALL\n".join(_CONSISTENCY.replace("{c}", c).replace("{t}", _MESSY) for c in ("mixed", "day", "code")),
)
def consistency_findings(spark, folder):
    return quality.consistency_findings(messy_lines(spark, folder))


@query(
    "document_consistency",
    "\nUNION ALL\n".join(_CONSISTENCY.replace("{c}", c).replace("{t}", "documents") for c in ("text", "lang", "source")),
)
def document_consistency(spark, folder):
    return quality.consistency_findings(table(spark, folder, "documents"))


@query(
    "document_case_variants",
    """WITH d AS (SELECT text FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT lower(substr(text, 1, 1)) || substr(text, 2) FROM documents WHERE text IS NOT NULL)
    SELECT 'text' AS "column", count(*) AS keys, count(*) FILTER (n > 1) AS inconsistent
    FROM (SELECT count(DISTINCT text) AS n FROM d GROUP BY lower(text))""",
)
def document_case_variants(spark, folder):
    """All documents, and each once more with a small first letter."""
    docs = table(spark, folder, "documents").select("text")
    small = docs.select(F.expr("concat(lower(substr(text, 1, 1)), substr(text, 2))").alias("text"))
    return quality.case_variants(docs.union(small))


@query(
    "case_variants",
    """SELECT 'code' AS "column", count(*) AS keys, count(*) FILTER (WHERE v > 1) AS inconsistent FROM
    (SELECT count(DISTINCT code) AS v FROM """ + _MESSY + """ GROUP BY lower(code))""",
)
def case_variants(spark, folder):
    return quality.case_variants(messy_lines(spark, folder).select("code"))


_SKEWED = """(SELECT exp(l_extendedprice / 20000) AS price, l_quantity * 4 AS age,
  l_shipdate + INTERVAL 40 YEAR AS created_at, l_tax FROM lineitem)"""


def skewed_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.exp(F.col("l_extendedprice") / 20000).alias("price"),
        (F.col("l_quantity") * 4).alias("age"),
        F.timestamp_add("YEAR", F.lit(40), F.col("l_shipdate")).alias("created_at"),
        "l_tax",
    )


@query(
    "validity_findings",
    union_all(
        f"""SELECT 'validity' AS aspect, 'extreme_outliers' AS type, '{{c}}' AS "column", k AS "count",
        round(k / n * 100, 2) AS percentage FROM (SELECT count({{c}}) AS n, count(*) FILTER (WHERE b > a AND
          ({{c}} < a - 3 * (b - a) OR {{c}} > b + 3 * (b - a))) AS k FROM {_SKEWED}, (SELECT
          quantile_cont({{c}}, 0.25) AS a, quantile_cont({{c}}, 0.75) AS b FROM {_SKEWED})) WHERE k > 0""",
        ["price", "age", "l_tax"],
    )
    + f""" UNION ALL SELECT 'validity', 'invalid_range', 'age', k, NULL FROM (SELECT count(*) FILTER
        (WHERE age < 0 OR age > 150) AS k FROM {_SKEWED}) WHERE k > 0
      UNION ALL SELECT 'validity', 'future_dates', 'created_at', k, NULL FROM (SELECT count(*) FILTER
        (WHERE created_at > now()::TIMESTAMP) AS k FROM {_SKEWED}) WHERE k > 0""",
)
def validity_findings(spark, folder):
    return quality.validity_findings(skewed_lines(spark, folder))


_TWINS = "(SELECT o_custkey, o_custkey AS customer_id, o_orderstatus, o_orderpriority FROM orders)"


def twin_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_custkey", F.col("o_custkey").alias("customer_id"), "o_orderstatus", "o_orderpriority"
    )


@query(
    "uniqueness_findings",
    f"""WITH d AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_TWINS})) AS k FROM orders)
    SELECT 'uniqueness' AS aspect, 'duplicate_rows' AS type, NULL AS "column", n - k AS "count",
      round((n - k) / n * 100, 2) AS percentage FROM d WHERE n > k
    UNION ALL SELECT 'uniqueness', 'duplicate_columns', 'o_custkey,customer_id', 2, NULL
    UNION ALL SELECT 'uniqueness', 'non_unique_id', 'o_custkey', count(*) - count(DISTINCT o_custkey), NULL FROM orders
    UNION ALL SELECT 'uniqueness', 'non_unique_id', 'customer_id', count(*) - count(DISTINCT o_custkey), NULL FROM orders
    """,
)
def uniqueness_findings(spark, folder):
    return quality.uniqueness_findings(twin_orders(spark, folder))


_VAGUE = """(SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' WHEN o_orderkey % 7 = 0 THEN 'N/A'
  ELSE o_orderpriority END AS priority, o_orderstatus, o_totalprice, o_totalprice * 2 + 1 AS double_price FROM orders)"""


def vague_orders(spark, folder):
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, "Unknown")
        .when(F.col("o_orderkey") % 7 == 0, "N/A")
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
        "o_orderstatus",
        "o_totalprice",
        (F.col("o_totalprice") * 2 + 1).alias("double_price"),
    )


@query(
    "accuracy_findings",
    f"""SELECT 'accuracy' AS aspect, 'placeholder_values' AS type, 'priority' AS "column", k AS "count",
      round(k / n * 100, 2) AS percentage FROM (SELECT count(priority) AS n, count(*) FILTER (WHERE lower(priority) IN
      ('unknown', 'null', 'n/a', 'na', 'none', '', 'missing')) AS k FROM {_VAGUE}) WHERE k > n * 0.1
    UNION ALL SELECT 'accuracy', 'perfect_correlations', 'o_totalprice~double_price', 1, NULL FROM
      (SELECT corr(o_totalprice, double_price) AS r FROM {_VAGUE}) WHERE abs(r) > 0.99""",
)
def accuracy_findings(spark, folder):
    return quality.accuracy_findings(vague_orders(spark, folder))


@query(
    "quality_issues",
    """SELECT 'high' AS severity, 'high_missing_values' AS type, 'c_acctbal' AS "column" FROM (SELECT
      count(*) FILTER (WHERE c_acctbal < 2000) / count(*) * 100 AS p FROM customer) WHERE p BETWEEN 5 AND 90
    UNION ALL SELECT 'high', 'high_missing_values', 'c_mktsegment' FROM (SELECT
      count(*) FILTER (WHERE c_mktsegment = 'BUILDING') / count(*) * 100 AS p FROM customer) WHERE p BETWEEN 5 AND 90
    UNION ALL SELECT 'high', 'constant_column', 'origin'
    UNION ALL SELECT 'critical', 'mostly_missing', 'rare' UNION ALL SELECT 'high', 'constant_column', 'rare'""",
)
def quality_issues(spark, folder):
    df = sparse_customers(spark, folder).withColumns(
        {"origin": F.lit("x"), "rare": F.when(F.col("c_custkey") == 1, F.lit(1))}
    )
    return quality.issues(df)


@query(
    "quality_scores",
    f"""WITH c AS (SELECT round(count(*) * 4 / (count(*) * 4) * 100, 2) AS completeness_score, count(*) AS n FROM orders),
    v AS (SELECT count(*) AS hits FROM (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75)
      AS b FROM orders) WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice < a - 3 * (b - a)
      OR o_totalprice > b + 3 * (b - a))),
    u AS (SELECT round((n - k) / n * 100, 2) AS pct FROM c, (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {_VAGUE})))
    SELECT completeness_score, 100.0::DOUBLE AS consistency_score, greatest(0, 100 - hits * 2 * 15)::DOUBLE AS validity_score,
      greatest(0, 100 - pct)::DOUBLE AS uniqueness_score, 60.0::DOUBLE AS accuracy_score, 0::BIGINT AS issues,
      round((completeness_score + 100 + greatest(0, 100 - hits * 2 * 15) + greatest(0, 100 - pct) + 60) / 5, 2)
        AS overall_score FROM c, v, u""",
)
def quality_scores(spark, folder):
    return quality.quality_scores(vague_orders(spark, folder))


@query(
    "recommendations",
    f"""SELECT 'Remove ' || (n - k)::VARCHAR || ' duplicate rows' AS recommendation, NULL AS "column" FROM
      (SELECT count(*) AS n FROM orders), (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM {_TWINS})) WHERE n > k
    UNION ALL SELECT 'Drop one of two identical columns', 'o_custkey,customer_id'""",
)
def recommendations(spark, folder):
    return quality.recommendations(twin_orders(spark, folder))


@query(
    "identical_columns",
    "SELECT 'o_custkey' AS column1, 'customer_id' AS column2 FROM orders HAVING count(*) > 0",
)
def identical_columns(spark, folder):
    return quality.identical_columns(twin_orders(spark, folder))


@query(
    "clean_table",
    f"""SELECT DISTINCT o_custkey, customer_id, o_orderstatus, o_orderpriority FROM {_TWINS}""",
)
def clean_table(spark, folder):
    df = twin_orders(spark, folder).withColumns(
        {"same": F.lit(1), "rare": F.when(F.col("o_custkey") == 1, F.lit(1))}
    )
    return cleaning.clean(df)


@query(
    "missing_drop_rows",
    f"SELECT * FROM {_SPARSE} WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL",
)
def missing_drop_rows(spark, folder):
    return cleaning.handle_missing(sparse_customers(spark, folder), "drop_rows")


@query(
    "missing_mean_and_mode",
    f"""WITH f AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS k, (SELECT c_mktsegment FROM {_SPARSE}
      WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m FROM {_SPARSE})
    SELECT c_custkey, round(coalesce(c_nationkey, k), 6) AS c_nationkey,
    round(coalesce(c_acctbal, a), 6) AS c_acctbal, coalesce(c_mktsegment, m) AS c_mktsegment FROM {_SPARSE}, f""",
)
def missing_mean_and_mode(spark, folder):
    return rounded(cleaning.handle_missing(sparse_customers(spark, folder), "mean_median"))


@query(
    "missing_forward_fill",
    f"""SELECT c_custkey, last_value(c_nationkey IGNORE NULLS) OVER w AS c_nationkey,
    last_value(c_acctbal IGNORE NULLS) OVER w AS c_acctbal, last_value(c_mktsegment IGNORE NULLS) OVER w AS c_mktsegment
    FROM {_SPARSE} WINDOW w AS (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)""",
)
def missing_forward_fill(spark, folder):
    return cleaning.handle_missing(sparse_customers(spark, folder), "forward_fill", order=["c_custkey"])


@query(
    "event_forward_fill",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events""",
)
def event_forward_fill(spark, folder):
    clicks = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("last_click")
    )
    filled = cleaning.forward_fill(clicks, ["last_click"], ["ts", "event_id"], ["user_id"])
    return filled.select("event_id", "user_id", "last_click")
