"""Queries: correlation, hypothesis tests, corrections and intervals."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.catalog import sqlmath
from tidemark.catalog.basics import MEASURES
from tidemark.catalog.registry import query, rounded, table, union_all
from tidemark.operators import bootstrap, correlation, hypothesis, replicates
from tidemark.operators.kendall import kendall

_STRENGTH = """CASE WHEN abs(r) >= 0.9 THEN 'very_strong' WHEN abs(r) >= 0.7 THEN 'strong'
  WHEN abs(r) >= 0.5 THEN 'moderate' WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very_weak' END"""
_APPROX = ("greatest(-1, r - 1.96 * 1.2 / sqrt(n - 3))", "least(1, r + 1.96 * 1.2 / sqrt(n - 3))")
_FISHER = ("tanh(atanh(r) - 1.96 / sqrt(n - 3))", "tanh(atanh(r) + 1.96 / sqrt(n - 3))")
_R_P = sqlmath.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "n - 2")


def _pair_report(inner: str, method: str, p: str, interval: tuple[str, str]) -> str:
    return f"""SELECT column1, column2, round(r, 8) AS correlation, round(abs(r), 8) AS abs_correlation,
      round(p, 8) AS p_value, p < 0.05 AS significant, {_STRENGTH} AS strength,
      CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, n AS sample_size,
      round({interval[0]}, 8) AS ci_lower, round({interval[1]}, 8) AS ci_upper, '{method}' AS method
    FROM (SELECT *, {p} AS p FROM ({inner}))"""


@query(
    "pearson",
    _pair_report(
        "\nUNION ALL\n".join(
            f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r, count(*) AS n FROM lineitem"
            for a, b in combinations(MEASURES, 2)
        ),
        "pearson", _R_P, _FISHER,
    ),
)
def pearson(spark, folder):
    return rounded(correlation.pearson(table(spark, folder, "lineitem"), MEASURES), 8)


_RANKED = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in MEASURES
)


@query(
    "spearman",
    _pair_report(
        "\nUNION ALL\n".join(
            f"SELECT '{a}' AS column1, '{b}' AS column2, corr(r_{a}, r_{b}) AS r, count(*) AS n"
            f" FROM (SELECT {_RANKED} FROM lineitem)"
            for a, b in combinations(MEASURES, 2)
        ),
        "spearman", _R_P, _APPROX,
    ),
)
def spearman(spark, folder):
    return rounded(correlation.spearman(table(spark, folder, "lineitem"), MEASURES), 8)


_TIES = """(SELECT sum(t * (t - 1) / 2.0) AS {s}p, sum(t * (t - 1) * (t - 2.0)) AS {s}0,
  sum(t * (t - 1) * (2.0 * t + 5)) AS {s}1 FROM (SELECT count(*)::DOUBLE AS t FROM customer GROUP BY {c}))"""


@query(
    "kendall",
    _pair_report(
        f"""SELECT 'c_nationkey' AS column1, 'c_acctbal' AS column2, s / sqrt((m / 2 - xp) * (m / 2 - yp)) AS r, n,
          s / sqrt((m * (2 * n + 5) - x1 - y1) / 18 + 2 * xp * yp / m + x0 * y0 / (9 * m * (n - 2))) AS z
        FROM (SELECT count(*) AS n, count(*)::DOUBLE * (count(*) - 1) AS m FROM customer),
          (SELECT sum(sign(a.c_nationkey - b.c_nationkey) * sign(a.c_acctbal - b.c_acctbal)) / 2.0 AS s
           FROM customer a, customer b),
          {_TIES.format(s='x', c='c_nationkey')}, {_TIES.format(s='y', c='c_acctbal')}""",
        "kendall", sqlmath.normal_two_sided("z"), _APPROX,
    ),
)
def kendall_pairs(spark, folder):
    return rounded(kendall(table(spark, folder, "customer"), ["c_nationkey", "c_acctbal"]), 8)


def _kendall_levels(a: str, b: str) -> str:
    """Kendall's sums from cumulative counts on the grid of both columns' values; one of them has few."""
    few, other = (b, a) if a == "l_extendedprice" else (a, b)
    ties = _TIES.replace("customer", "lineitem")
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, s / sqrt((m / 2 - xp) * (m / 2 - yp)) AS r, n,
      s / sqrt((m * (2 * n + 5) - x1 - y1) / 18 + 2 * xp * yp / m + x0 * y0 / (9 * m * (n - 2))) AS z
    FROM (SELECT count(*) AS n, count(*)::DOUBLE * (count(*) - 1) AS m FROM lineitem),
      (SELECT sum(k * (2 * less + below - whole)) AS s FROM (
        SELECT k, below, sum(below) OVER (PARTITION BY y) AS whole, coalesce(sum(below) OVER (PARTITION BY y ORDER BY x
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM (
          SELECT x, y, k, coalesce(sum(k) OVER (PARTITION BY x ORDER BY y
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
            SELECT x, y, coalesce(k, 0) AS k FROM (SELECT x, y FROM (SELECT DISTINCT {few} AS x FROM lineitem),
              (SELECT DISTINCT {other} AS y FROM lineitem)) LEFT JOIN (SELECT {few} AS x, {other} AS y,
              count(*)::DOUBLE AS k FROM lineitem GROUP BY ALL) USING (x, y))))),
      {ties.format(s='x', c=a)}, {ties.format(s='y', c=b)}"""


@query(
    "kendall_line_items",
    _pair_report(
        "\nUNION ALL\n".join(f"({_kendall_levels(a, b)})" for a, b in combinations(MEASURES, 2)),
        "kendall", sqlmath.normal_two_sided("z"), _APPROX,
    ),
)
def kendall_line_items(spark, folder):
    """Every pair of the four measures over all line items."""
    return rounded(kendall(table(spark, folder, "lineitem"), MEASURES), 8)


def _chi_square(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS column1, '{b}' AS column2, chi2, levels_a, levels_b, n FROM (
      SELECT sum(greatest(abs(coalesce(o, 0) - e) - CASE WHEN levels_a = 2 AND levels_b = 2 THEN 0.5 ELSE 0 END, 0)
        ** 2 / e) AS chi2, any_value(levels_a) AS levels_a, any_value(levels_b) AS levels_b, any_value(n) AS n FROM (
      SELECT x.v AS va, y.v AS vb, x.k * y.k / n::DOUBLE AS e, n, levels_a, levels_b FROM
        (SELECT {a} AS v, count(*) AS k FROM orders GROUP BY 1) x, (SELECT {b} AS v, count(*) AS k FROM orders GROUP BY 1) y,
        (SELECT count(*) AS n, count(DISTINCT {a}) AS levels_a, count(DISTINCT {b}) AS levels_b FROM orders))
      LEFT JOIN (SELECT {a} AS va, {b} AS vb, count(*) AS o FROM orders GROUP BY 1, 2) USING (va, vb))"""


_CATEGORY_ORDERS = """(SELECT o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END
  AS price_class, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'first' ELSE o_orderstatus END AS mixed FROM orders)"""
_CATEGORIES = ["o_orderstatus", "o_orderpriority", "price_class", "parity", "mixed"]


def category_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderstatus",
        "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "big").otherwise("small").alias("price_class"),
        F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("parity"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "first").otherwise(F.col("o_orderstatus")).alias("mixed"),
    )


@query(
    "chi_square",
    f"""SELECT column1, column2, round(chi2, 6) AS chi2_statistic, round(p, 8) AS p_value, dof AS degrees_of_freedom,
      round(sqrt(chi2 / n / (least(levels_a, levels_b) - 1)), 8) AS cramers_v, p < 0.05 AS significant, n AS sample_size
    FROM (SELECT *, {sqlmath.chi2_tail('chi2', 'dof')} AS p FROM (SELECT *, (levels_a - 1) * (levels_b - 1) AS dof FROM (
    """
    + "\nUNION ALL\n".join(
        _chi_square(a, b).replace("FROM orders", f"FROM {_CATEGORY_ORDERS}") for a, b in combinations(_CATEGORIES, 2)
    )
    + ")))",
)
def chi_square(spark, folder):
    return rounded(
        correlation.cramers_v_pairs(category_orders(spark, folder), _CATEGORIES), 8, chi2_statistic=6
    )


_FLAG = "l_returnflag"
_TARGETS = ["l_quantity", "l_extendedprice", "l_discount"]


def _anova_core(rows: str) -> str:
    """F-test columns of one value per (column, grp) row set."""
    return f"""SELECT "column", count(*) AS groups, sum(n)::BIGINT AS n, sum(n * (mean - grand) ** 2) AS between,
        sum(inner_ss) AS inner_ss FROM (SELECT *, sum(n * mean) OVER w / sum(n) OVER w AS grand FROM (
          SELECT "column", grp, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS inner_ss FROM ({rows})
          GROUP BY ALL) WINDOW w AS (PARTITION BY "column")) GROUP BY "column\""""


def _stacked(targets, source="lineitem", group=_FLAG) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {group}::VARCHAR AS grp, {c}::DOUBLE AS v FROM {source} WHERE {group} IS NOT NULL
        AND {c} IS NOT NULL""" for c in targets
    )


def _f_report(rows: str, with_eta: bool) -> str:
    eta = ", round(between / (between + inner_ss), 10) AS eta_squared" if with_eta else ""
    return f"""SELECT "column", groups, n, round(f, 6) AS statistic, groups - 1 AS df_between, n - groups AS df_within,
      round({sqlmath.f_tail('f', '(groups - 1)', '(n - groups)')}, 8) AS p_value{eta}
    FROM (SELECT *, (between / (groups - 1)) / (inner_ss / (n - groups)) AS f FROM ({_anova_core(rows)}))"""


_SPREAD = f"""SELECT "column", grp, abs(v - median(v) OVER (PARTITION BY "column", grp)) AS v
  FROM ({_stacked(_TARGETS)})"""


@query("anova", _f_report(_stacked(_TARGETS), True))
def anova(spark, folder):
    out = hypothesis.anova(table(spark, folder, "lineitem"), _FLAG, _TARGETS)
    return rounded(out, 8, statistic=6, eta_squared=10)


@query("levene", _f_report(_SPREAD, False))
def levene(spark, folder):
    return rounded(hypothesis.levene(table(spark, folder, "lineitem"), _FLAG, _TARGETS), 8, statistic=6)


def _kruskal(rows: str) -> str:
    return f"""SELECT "column", groups, n, h AS statistic, {sqlmath.chi2_tail('h', '(groups - 1)')} AS p_value,
      greatest(0, (h - groups + 1) / (n - groups)) AS epsilon_squared FROM (
      SELECT "column", count(*) AS groups, any_value(total) AS n, 12.0 / (any_value(total) * (any_value(total) + 1.0))
        * sum(k * (mean_rank - (total + 1) / 2.0) ** 2) / (1 - any_value(ties) / (any_value(total)::DOUBLE ** 3
        - any_value(total))) AS h FROM (
      SELECT "column", grp, count(*) AS k, avg(r) AS mean_rank, any_value(total) AS total FROM (
        SELECT "column", grp, rank() OVER (PARTITION BY "column" ORDER BY v)
          + (count(*) OVER (PARTITION BY "column", v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY "column") AS total
        FROM ({rows})) GROUP BY "column", grp)
      JOIN (SELECT "column", sum(t ** 3 - t) AS ties FROM (SELECT "column", v, count(*)::DOUBLE AS t FROM ({rows})
        GROUP BY ALL) GROUP BY 1) USING ("column") GROUP BY "column")"""


@query(
    "kruskal",
    f"""SELECT "column", groups, n, round(statistic, 6) AS statistic, round(p_value, 8) AS p_value,
    round(epsilon_squared, 8) AS epsilon_squared FROM ({_kruskal(_stacked(_TARGETS))})""",
)
def kruskal(spark, folder):
    return rounded(hypothesis.kruskal(table(spark, folder, "lineitem"), _FLAG, _TARGETS), 8, statistic=6)


def _effect(measure: str, limits: tuple[float, float, float]) -> str:
    a, b, c = limits
    return f"""CASE WHEN abs({measure}) < {a} THEN 'negligible' WHEN abs({measure}) < {b} THEN 'small'
      WHEN abs({measure}) < {c} THEN 'medium' ELSE 'large' END"""


@query(
    "mann_whitney_pairs",
    f"""WITH e AS (SELECT event_type AS g, value AS v FROM events),
    k AS (SELECT g, count(*) AS n, median(v) AS m FROM e GROUP BY 1),
    p AS (SELECT a.g AS g1, b.g AS g2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2 FROM k a JOIN k b ON a.g < b.g),
    r AS (SELECT g1, g2, n1, n2, m1, m2, g, rank() OVER w + (count(*) OVER (PARTITION BY g1, g2, v) - 1) / 2.0 AS r
      FROM p JOIN e ON g IN (g1, g2) WINDOW w AS (PARTITION BY g1, g2 ORDER BY v)),
    u AS (SELECT g1, g2, n1, n2, m1, m2, sum(r) FILTER (WHERE g = g1) - n1 * (n1 + 1) / 2.0 AS u FROM r GROUP BY g1, g2, n1, n2, m1, m2),
    t AS (SELECT g1, g2, sum(c ** 3 - c) AS ties FROM (SELECT g1, g2, v, count(*)::DOUBLE AS c FROM p JOIN e
      ON g IN (g1, g2) GROUP BY ALL) GROUP BY 1, 2),
    z AS (SELECT *, 1 - 2 * u / (n1 * n2) AS rb, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0
      * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z FROM u JOIN t USING (g1, g2)),
    q AS (SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE {sqlmath.normal_two_sided('z')} END AS p FROM z)
    SELECT g1 AS group1, g2 AS group2, n1, n2, u AS statistic, round(p, 8) AS p_value, p < 0.05 AS significant,
      round(rb, 8) AS rank_biserial, {_effect('rb', (0.1, 0.3, 0.5))} AS interpretation, m1 AS median1, m2 AS median2
    FROM q""",
)
def mann_whitney_pairs(spark, folder):
    return rounded(hypothesis.pairwise_mann_whitney(table(spark, folder, "events"), "event_type", "value"), 8)


_T_PAIRS = f"""WITH k AS (SELECT '{{c}}' AS c, event_type AS g, count({{c}}) AS n, avg({{c}}) AS m,
    stddev_samp({{c}}) AS s FROM events GROUP BY event_type),
  p AS (SELECT a.c, a.g AS g1, b.g AS g2, a.n AS n1, b.n AS n2, a.m - b.m AS gap, a.n + b.n - 2 AS dof,
    sqrt(((a.n - 1) * a.s ** 2 + (b.n - 1) * b.s ** 2) / (a.n + b.n - 2)) AS pooled,
    sqrt(a.s ** 2 / a.n + b.s ** 2 / b.n) AS se FROM k a JOIN k b ON a.g < b.g),
  t AS (SELECT *, gap / (pooled * sqrt(1.0 / n1 + 1.0 / n2)) AS t, gap / pooled AS d,
    {sqlmath.t_quantile_975('dof')} * se AS reach FROM p),
  q AS (SELECT *, {sqlmath.t_two_sided('t', 'dof')} AS p FROM t)
  SELECT c AS "column", g1 AS group1, g2 AS group2, n1, n2, round(t, 8) AS statistic, round(p, 8) AS p_value,
    p < 0.05 AS significant, round(d, 8) AS cohens_d, {_effect('d', (0.2, 0.5, 0.8))} AS interpretation,
    round(gap, 8) AS mean_difference, round(gap - reach, 6) AS ci_lower, round(gap + reach, 6) AS ci_upper FROM q"""


@query("t_test_pairs", _T_PAIRS.replace("{c}", "value"))
def t_test_pairs(spark, folder):
    out = hypothesis.pairwise_t_tests(table(spark, folder, "events"), "event_type", ["value"])
    return rounded(out, 8, ci_lower=6, ci_upper=6)


@query(
    "mean_intervals",
    f"""WITH k AS (SELECT l_returnflag AS grp, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS s
      FROM lineitem GROUP BY 1), m AS (SELECT *, {sqlmath.t_quantile_975('(n - 1)')} * s / sqrt(n) AS margin FROM k)
    SELECT 'l_quantity' AS "column", grp, n, round(mean, 6) AS mean, round(margin, 6) AS margin_error,
      round(mean - margin, 6) AS lower, round(mean + margin, 6) AS upper FROM m""",
)
def mean_intervals(spark, folder):
    return rounded(hypothesis.mean_intervals(table(spark, folder, "lineitem"), _FLAG, ["l_quantity"]))


@query("shapiro_by_group")
def shapiro_by_group(spark, folder):
    return rounded(hypothesis.shapiro(table(spark, folder, "customer"), "c_mktsegment", ["c_acctbal"]))


_PHI = f"(0.5 * (1 + sign(z) * (1 - ({sqlmath.normal_two_sided('z')}))))"


@query(
    "anderson_darling",
    f"""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem),
    g AS (SELECT l_extendedprice AS v, count(*) AS c FROM lineitem GROUP BY 1),
    b AS (SELECT (v - m) / s AS z, c, n, sum(c) OVER (ORDER BY v) - c AS b FROM g, s),
    p AS (SELECT *, {_PHI} AS phi FROM b),
    a AS (SELECT any_value(n) AS n, -any_value(n) - sum(c * (2 * b + c) * ln(phi) + c * (2 * n - 2 * b - c)
      * ln(1 - phi)) / any_value(n) AS a FROM p)
    SELECT 'l_extendedprice' AS "column", n, round(a, 4) AS statistic,
      round(0.787 / (1 + 4.0 / n - 25.0 / (n * n)), 3) AS critical_value,
      a < round(0.787 / (1 + 4.0 / n - 25.0 / (n * n)), 3) AS is_normal FROM a""",
)
def anderson_darling(spark, folder):
    return rounded(hypothesis.anderson_darling(table(spark, folder, "lineitem"), ["l_extendedprice"]), 4)


def _anderson(rows: str) -> str:
    """Smallest Anderson-Darling p-value over the groups of each column; for groups of over 5000 rows."""
    return f"""SELECT "column", min(CASE WHEN x < 0.2 THEN 1 - exp(-13.436 + 101.14 * x - 223.73 * x * x)
        WHEN x < 0.34 THEN 1 - exp(-8.318 + 42.796 * x - 59.938 * x * x)
        WHEN x < 0.6 THEN exp(0.9177 - 4.279 * x - 1.38 * x * x) ELSE exp(1.2937 - 5.709 * x + 0.0186 * x * x) END) AS np
      FROM (SELECT "column", least(13, a * (1 + 0.75 / n + 2.25 / (n * n))) AS x FROM (
        SELECT "column", grp, any_value(n) AS n, -any_value(n) - sum(c * (2 * b + c) * ln(phi)
          + c * (2 * n - 2 * b - c) * ln(1 - phi)) / any_value(n) AS a FROM (SELECT *, {_PHI} AS phi FROM (
            SELECT "column", grp, (v - m) / s AS z, c, n, sum(c) OVER (PARTITION BY "column", grp ORDER BY v) - c AS b
            FROM (SELECT "column", grp, v, count(*) AS c FROM ({rows}) GROUP BY ALL) JOIN (SELECT "column", grp,
              count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM ({rows}) GROUP BY ALL) USING ("column", grp)))
        GROUP BY "column", grp)) GROUP BY "column\""""


def _bh(tests: str, p: str = "p_value") -> str:
    return f"""SELECT *, p_value_corrected <= 0.05 AS significant_corrected FROM (SELECT *, least(1, min(q) OVER
      (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS p_value_corrected FROM (SELECT *, {p} * count(*) OVER ()
      / max(k) OVER (PARTITION BY {p}) AS q FROM (SELECT *, row_number() OVER (ORDER BY {p}) AS k FROM ({tests}))))"""


@query(
    "benjamini_hochberg",
    f"""SELECT "column", group1, group2, round(p_value, 8) AS p_value, round(p_value_corrected, 8) AS p_value_corrected,
      significant_corrected, round(0.05 / m, 10) AS alpha_bonferroni, round(1 - 0.95 ** (1 / m), 10) AS alpha_sidak
    FROM (SELECT *, count(*) OVER () AS m FROM ({_bh(f'''SELECT "column", group1, group2, p AS p_value FROM (
      {_T_PAIRS.replace('{c}', 'value').replace('round(p, 8) AS p_value', 'p')})''')}))""",
)
def benjamini_hochberg(spark, folder):
    tests = hypothesis.pairwise_t_tests(table(spark, folder, "events"), "event_type", ["value"])
    out = hypothesis.benjamini_hochberg(tests).select(
        "column", "group1", "group2", "p_value", "p_value_corrected", "significant_corrected", "alpha_bonferroni",
        "alpha_sidak",
    )
    return rounded(out, 8, alpha_bonferroni=10, alpha_sidak=10)


@query(
    "correction_summary",
    f"""SELECT count(*) AS total_tests, count(*) FILTER (WHERE p_value < 0.05) AS significant_before_correction,
    count(*) FILTER (WHERE significant_corrected) AS significant_after_correction
    FROM ({_bh(f'''SELECT p AS p_value FROM (
      {_T_PAIRS.replace('{c}', 'value').replace('round(p, 8) AS p_value', 'p')})''')})""",
)
def correction_summary(spark, folder):
    tests = hypothesis.pairwise_t_tests(table(spark, folder, "events"), "event_type", ["value"])
    return hypothesis.correction_summary(hypothesis.benjamini_hochberg(tests))


@query(
    "group_comparison",
    f"""WITH l AS (SELECT "column" AS c, p_value AS levene_p FROM ({_f_report(_SPREAD, False).replace('round(CASE', '(CASE').replace(', 8) AS p_value', ') AS p_value')})),
    f AS (SELECT "column", groups, n, f, {sqlmath.f_tail('f', '(groups - 1)', '(n - groups)')} AS fp,
      between / (between + inner_ss) AS eta FROM (SELECT *, (between / (groups - 1)) / (inner_ss / (n - groups)) AS f
      FROM ({_anova_core(_stacked(_TARGETS))}))),
    h AS (SELECT "column" AS k, statistic AS h, p_value AS hp, epsilon_squared AS eps FROM ({_kruskal(_stacked(_TARGETS))})),
    a AS (SELECT "column" AS ac, np FROM ({_anderson(_stacked(_TARGETS))})),
    m AS (SELECT *, levene_p > 0.05 AND np > 0.05 AS met FROM f JOIN l ON c = "column" JOIN h ON k = "column"
      JOIN a ON ac = "column"),
    j AS (SELECT *, CASE WHEN met THEN eta ELSE eps END AS effect FROM m)
    SELECT "column", groups, n, CASE WHEN met THEN 'anova' ELSE 'kruskal_wallis' END AS test,
      round(CASE WHEN met THEN f ELSE h END, 6) AS statistic, round(CASE WHEN met THEN fp ELSE hp END, 8) AS p_value,
      CASE WHEN met THEN fp ELSE hp END < 0.05 AS significant, round(effect, 8) AS effect_size,
      CASE WHEN met THEN 'eta_squared' ELSE 'epsilon_squared' END AS effect_measure,
      {_effect('effect', (0.01, 0.06, 0.14))} AS interpretation, round(np, 8) AS lowest_normal_p,
      round(levene_p, 8) AS levene_p, met AS assumptions_met
    FROM j""",
)
def group_comparison(spark, folder):
    """Groups hold over 5000 rows each from scale 0.01 on, where normality is by Anderson-Darling."""
    out = hypothesis.compare_groups(table(spark, folder, "lineitem"), _FLAG, _TARGETS)
    return rounded(out, 8, statistic=6)


@query("two_group_comparison")
def two_group_comparison(spark, folder):
    out = hypothesis.compare_two_groups(
        table(spark, folder, "customer"), "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal"
    )
    return rounded(out)


@query(
    "group_analysis",
    union_all(
        f"""SELECT '{{c}}' AS "column", l_returnflag AS grp, n, round(mean, 5) AS mean, round(std, 5) AS std, lo AS min,
        hi AS max, round(m, 5) AS median, round(a, 5) AS q25, round(b, 5) AS q75, round(b - a, 5) AS iqr,
        round(mad, 5) AS mad, round(a - 1.5 * (b - a), 5) AS lower_fence, round(b + 1.5 * (b - a), 5) AS upper_fence,
        round(mean - {sqlmath.t_quantile_975('(n - 1)')} * std / sqrt(n), 5) AS lower,
        round(mean + {sqlmath.t_quantile_975('(n - 1)')} * std / sqrt(n), 5) AS upper
        FROM (SELECT l_returnflag, count(*) AS n, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, min({{c}}) AS lo,
          max({{c}}) AS hi, median({{c}}) AS m, quantile_cont({{c}}, 0.25) AS a, quantile_cont({{c}}, 0.75) AS b,
          mad({{c}}) AS mad FROM lineitem GROUP BY 1)""",
        ["l_quantity", "l_discount"],
    ),
)
def group_analysis(spark, folder):
    return rounded(hypothesis.group_analysis(table(spark, folder, "lineitem"), _FLAG, ["l_quantity", "l_discount"]), 5)


@query(
    "linear_trend",
    f"""WITH p AS (SELECT event_type, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1
      AS x FROM events), f AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icpt,
      corr(y, x) AS r, var_pop(y) AS yy, var_pop(x) AS xx FROM p GROUP BY 1)
    SELECT event_type, n, round(slope, 8) AS slope, round(icpt, 6) AS intercept, round(r, 8) AS r,
      round({_R_P}, 8) AS p_value, round(sqrt((1 - r * r) * yy / xx / (n - 2)), 8) AS std_err FROM f""",
)
def linear_trend(spark, folder):
    out = hypothesis.linear_trend(table(spark, folder, "events"), "value", ["ts", "event_id"], ["event_type"])
    return rounded(out, 8, intercept=6)


@query("bootstrap_median_intervals")
def bootstrap_median_intervals(spark, folder):
    return rounded(bootstrap.median_intervals(table(spark, folder, "lineitem"), _FLAG, ["l_extendedprice", "l_quantity"]))


@query("bootstrap_median_difference")
def bootstrap_median_difference(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(bootstrap.median_difference_interval(line, _FLAG, "A", "R", "l_extendedprice"))


def _replicates(rows: str, draws: int, sums: str, value: str) -> str:
    """The replicate weights of (grp, name, y, x) and a statistic of their sums."""
    a, b, c = replicates.MULTIPLIERS
    m = replicates.MODULUS
    drawn = " + ".join(f"(h >= {limit})::INT" for limit in replicates.poisson_limits())
    return f"""WITH r AS (SELECT grp, ('0x' || left(md5('42:' || name), 7))::BIGINT AS s, y, x FROM ({rows})),
    m AS (SELECT *, avg(y) OVER (PARTITION BY grp) AS centre, avg(x) OVER (PARTITION BY grp) AS middle FROM r),
    d AS (SELECT grp, centre, y - centre AS y, x - middle AS x, draw,
          xor((s + 1) * {a} % {m}, (draw + 1) * {b} * {a} % {m}) * {c} % {m} AS g
          FROM m, (SELECT unnest(range({draws})) AS draw)),
    w AS (SELECT * EXCLUDE (g), xor(g, g >> 15) * {a} % {m} AS h FROM d),
    p AS (SELECT *, ({drawn})::DOUBLE AS k FROM w),
    t AS (SELECT grp, draw, any_value(centre) AS centre, sum(k) AS w, {sums} FROM p WHERE k > 0 GROUP BY grp, draw),
    v AS (SELECT grp, {value} AS value FROM t)
    SELECT grp, count(value) AS replicates, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS error,
      round(quantile_cont(value, 0.025), 6) AS ci_lower, round(quantile_cont(value, 0.975), 6) AS ci_upper
    FROM v WHERE value IS NOT NULL GROUP BY grp"""


_LINE_ROWS = """SELECT l_returnflag AS grp, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS name,
    l_quantity AS y, 0.0 AS x FROM lineitem"""
_LINE_NAMES = ["l_orderkey", "l_linenumber", "l_partkey"]
_EVENT_ROWS = """SELECT event_type AS grp, event_id::VARCHAR AS name, value AS y, user_id::DOUBLE AS x FROM events
    WHERE event_type IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL"""


@query("bootstrap_mean", _replicates(_LINE_ROWS, 200, "sum(k * y) AS y", "centre + y / w"))
def bootstrap_mean(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(replicates.bootstrap(line, "l_quantity", _LINE_NAMES, group=_FLAG))


@query(
    "bootstrap_deviation",
    _replicates(
        _EVENT_ROWS, 200, "sum(k * y) AS y, sum(k * y * y) AS yy", "CASE WHEN w > 1 THEN sqrt(greatest(0, yy - y * y / w) / (w - 1)) END"
    ),
)
def bootstrap_deviation(spark, folder):
    events = table(spark, folder, "events")
    return rounded(replicates.bootstrap(events, "value", ["event_id"], replicates.DEVIATION, "event_type"))


@query(
    "bootstrap_trend",
    _replicates(
        _EVENT_ROWS, 200, "sum(k * x) AS x, sum(k * y) AS y, sum(k * x * y) AS xy, sum(k * x * x) AS xx",
        "(xy - x * y / w) / nullif(xx - x * x / w, 0)",
    ),
)
def bootstrap_trend(spark, folder):
    events = table(spark, folder, "events")
    return rounded(replicates.bootstrap(events, "value", ["event_id"], replicates.SLOPE, "event_type", "user_id"))
