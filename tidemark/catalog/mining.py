"""Queries: associations, clusters, outliers, rules, series, drivers and seasonality."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.catalog import sqlmath
from tidemark.catalog.basics import MEASURES
from tidemark.catalog.inference import (
    _anderson,
    _CATEGORY_ORDERS, _R_P, _anova_core, _bh, _chi_square, _kruskal, _stacked, category_orders,
)
from tidemark.catalog.registry import query, rounded, table, union_all
from tidemark.operators import anomalies, associations, clustering, dbscan, drivers, timeseries
from tidemark.sources import readers

# --- associations ----------------------------------------------------------------

_RULE_COLUMNS = ["o_orderstatus", "o_orderpriority", "price_class"]
_RULES = "\nUNION ALL\n".join(
    f"""SELECT '{a}' AS column1, {a} AS value1, '{b}' AS column2, {b} AS value2, k AS "count", k / n AS support,
      k / n1 AS confidence, k * n::DOUBLE / (n1::DOUBLE * n2) AS lift FROM (SELECT {a}, {b}, count(*) AS k FROM
      {_CATEGORY_ORDERS} GROUP BY 1, 2) JOIN (SELECT {a}, count(*) AS n1 FROM {_CATEGORY_ORDERS} GROUP BY 1) USING ({a})
      JOIN (SELECT {b}, count(*) AS n2 FROM {_CATEGORY_ORDERS} GROUP BY 1) USING ({b}), (SELECT count(*) AS n FROM orders)
      WHERE k >= 0.1 * n"""
    for a, b in combinations(_RULE_COLUMNS, 2)
)


@query(
    "association_rules",
    f"""SELECT column1, value1, column2, value2, "count", round(support, 8) AS support, round(confidence, 8) AS confidence,
    round(lift, 8) AS lift FROM ({_RULES})""",
)
def association_rules(spark, folder):
    return rounded(associations.association_rules(category_orders(spark, folder), _RULE_COLUMNS), 8)


@query(
    "best_associations",
    f"""SELECT column1, value1, column2, value2, "count", round(support, 8) AS support, round(confidence, 8) AS confidence,
    round(lift, 8) AS lift FROM ({_RULES}) QUALIFY row_number() OVER (PARTITION BY column1, column2
    ORDER BY lift DESC, value1, value2) = 1 ORDER BY lift DESC, column1, column2 LIMIT 20""",
)
def best_associations(spark, folder):
    return rounded(associations.best_associations(category_orders(spark, folder), _RULE_COLUMNS), 8)


_PART_TEST = f"""SELECT 'pearson' AS test, 'p_size' AS column1, 'p_retailprice' AS column2, r AS statistic,
    {_R_P} AS p_value, abs(r) AS effect, abs(r) > 0.7 AS large FROM (SELECT corr(p_size, p_retailprice) AS r,
    count(*) AS n FROM part)
  UNION ALL SELECT 'chi_square', column1, column2, chi2, {sqlmath.chi2_tail('chi2', '((levels_a - 1) * (levels_b - 1))')},
    sqrt(chi2 / n / (least(levels_a, levels_b) - 1)), sqrt(chi2 / n / (least(levels_a, levels_b) - 1)) > 0.5
    FROM ({_chi_square('p_brand', 'p_type').replace('FROM orders', 'FROM part')})
  """ + "".join(
    f"""UNION ALL SELECT * FROM (SELECT 'anova', "column", '{g}', f, {sqlmath.f_tail('f', '(groups - 1)', '(n - groups)')}
    AS p, between / (between + inner_ss), false FROM (SELECT *, (between / (groups - 1)) / (inner_ss / (n - groups)) AS f
    FROM ({_anova_core(_stacked(['p_size', 'p_retailprice'], 'part', g))}))) WHERE p < 0.05 """
    for g in ("p_brand", "p_type")
)


@query(
    "association_report",
    f"""SELECT test, column1, column2, round(statistic, 6) AS statistic, round(p_value, 8) AS p_value,
    round(p_value_corrected, 8) AS p_value_corrected, round(effect, 8) AS effect, p_value < 0.05 AS significant,
    significant_corrected, p_value < 0.05 AND "large" AS strong FROM ({_bh(_PART_TEST)})""",
)
def association_report(spark, folder):
    out = associations.association_report(
        table(spark, folder, "part"), numbers=["p_size", "p_retailprice"], categories=["p_brand", "p_type"]
    )
    return rounded(out, 8, statistic=6)


# --- clusters --------------------------------------------------------------------

_CLUSTER_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _scaled(source: str, features: list[str]) -> str:
    """Common tables src, lim and pts: features clipped to q01-q99 as v0 ..., robustly scaled as s0 ..."""
    dims = range(len(features))
    points = {"l": 0.01, "a": 0.25, "b": 0.5, "c": 0.75, "h": 0.99}
    limits = ", ".join(f"quantile_cont(v{i}, {q}) AS {n}{i}" for i in dims for n, q in points.items())
    columns = ", ".join(
        f"least(greatest(v{i}, l{i}), h{i}) AS v{i}, (least(greatest(v{i}, l{i}), h{i}) - b{i}) / "
        f"CASE WHEN c{i} = a{i} THEN 1 ELSE c{i} - a{i} END AS s{i}"
        for i in dims
    )
    return f"""src AS (SELECT {", ".join(f"{f}::DOUBLE AS v{i}" for i, f in enumerate(features))}
      FROM {source} WHERE {" AND ".join(f"{f} IS NOT NULL" for f in features)}),
    lim AS (SELECT {limits} FROM src), pts AS MATERIALIZED (SELECT {columns} FROM src, lim)"""


def _kmeans(source: str, features: list[str], k: int | None = None) -> str:
    """Common tables that end in ``labelled`` (v0 ..., s0 ..., cluster).

    A clustering is one row: its number, lists of centres, sums of squares and sizes.
    """
    dims = range(len(features))
    far = " + ".join(f"(s{i} - q[{i + 1}]) ** 2" for i in dims)
    means = ", ".join(f"avg(s{i})" for i in dims)
    squares = ", ".join(f"var_pop(s{i}) * count(*)" for i in dims)

    def near(clustering: str) -> str:
        return f"""(SELECT *, list_position(ds, list_min(ds)) AS j FROM (SELECT pts.*, z.*, list_transform(z.c,
          lambda q: {far}) AS ds FROM pts, {clustering} z))"""

    def described(clustering: str) -> str:
        return f"""SELECT list(m ORDER BY j) AS c, list(ss ORDER BY j) AS ss, list(n ORDER BY j) AS n FROM
          (SELECT j, [{means}] AS m, [{squares}] AS ss, count(*) AS n FROM {near(clustering)} GROUP BY j)"""

    most = k or max(clustering.CANDIDATE_K)
    steps = [f"(SELECT [[{means}]] AS c FROM pts)"]
    tables = [f"g1 AS MATERIALIZED ({described(steps[0])})"]
    for i in range(2, most + 1):
        tables.append(
            f"""w{i} AS (SELECT *, list_position(ss[pick], list_max(ss[pick])) AS dim FROM (SELECT *, list_position(costs,
              list_max(costs)) AS pick FROM (SELECT *, list_transform(ss, lambda q: list_sum(q)) AS costs FROM g{i - 1}))),
            r{i} AS (SELECT *, sqrt(ss[pick][dim] / n[pick]) AS reach FROM w{i}),
            p{i} AS (SELECT list_append(list_transform(c, lambda q, i: CASE WHEN i = pick THEN list_transform(q,
              lambda x, t: x - CASE WHEN t = dim THEN reach ELSE 0 END) ELSE q END), list_transform(c[pick],
              lambda x, t: x + CASE WHEN t = dim THEN reach ELSE 0 END)) AS c FROM r{i}),
            a{i} AS MATERIALIZED ({described(f"p{i}")}),
            g{i} AS MATERIALIZED ({described(f"(SELECT c FROM a{i})")})"""
        )
    grown = " UNION ALL ".join(
        f"SELECT {i} AS k, c, list_sum(list_transform(ss, lambda q: list_sum(q))) AS cost FROM g{i}"
        for i in range(1, most + 1)
    )
    chosen = str(k) if k else f"""(SELECT CASE WHEN max("drop") > 0 THEN least(arg_max(k, "drop"),
        {clustering.LARGEST_K}) ELSE {clustering.CANDIDATE_K[0]} END FROM (SELECT k, gain - lead(gain) OVER (ORDER BY k)
        AS "drop" FROM (SELECT k, lag(cost) OVER (ORDER BY k) - cost AS gain FROM grown
        WHERE k >= {clustering.CANDIDATE_K[0]})))"""
    return f"""WITH RECURSIVE {_scaled(source, features)}, {", ".join(tables)}, grown AS MATERIALIZED ({grown}),
    settled(step, c, moved) AS (SELECT 0, c, 1e300::DOUBLE FROM grown WHERE k = {chosen} UNION ALL
      SELECT step + 1, list(m ORDER BY j), max(list_distance(m, old)) FROM
      (SELECT step, j, [{means}] AS m, any_value(c[j]) AS old FROM
      {near(f"(SELECT * FROM settled WHERE step < {clustering.MAX_ITERATIONS} AND moved > {clustering.TOLERANCE})")}
      GROUP BY step, j) GROUP BY step),
    final AS MATERIALIZED (SELECT list_sort(arg_max(c, step)) AS c FROM settled),
    labelled AS MATERIALIZED (SELECT * EXCLUDE (c, ds, j), (j - 1)::INT AS cluster FROM {near("final")})
    """


def _profile(features: list[str], name: str = "'cluster_' || cluster::VARCHAR") -> str:
    """The profile of ``labelled`` (v0 ..., cluster)."""
    return "\nUNION ALL\n".join(
        f"""SELECT cluster, '{f}' AS "column", count(*) AS size, round(avg(v{i}), 6) AS mean,
        round(stddev_samp(v{i}), 6) AS std, round(min(v{i}), 6) AS min, round(max(v{i}), 6) AS max,
        round(count(*) / (SELECT count(*) FROM labelled) * 100, 6) AS percentage, round(median(v{i}), 6) AS median,
        {name} AS cluster_name FROM labelled GROUP BY cluster"""
        for i, f in enumerate(features)
    )


# Validation of p (c, x, y), to follow the common table p.
_VALIDATION = """,
    m AS (SELECT c, count(*) AS k, avg(x) AS mx, avg(y) AS my, sum(x * x + y * y) AS sq FROM p GROUP BY 1),
    g AS (SELECT count(*) AS clusters, sum(k) AS n, sum(k * mx) / sum(k) AS gx, sum(k * my) / sum(k) AS gy FROM m),
    w AS (SELECT c, sum((x - mx) ** 2 + (y - my) ** 2) AS ss, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS s
      FROM p JOIN m USING (c) GROUP BY 1),
    b AS (SELECT sum(k * ((mx - gx) ** 2 + (my - gy) ** 2)) AS between FROM m, g),
    r AS (SELECT a.c, max((wa.s + wb.s) / sqrt((a.mx - z.mx) ** 2 + (a.my - z.my) ** 2)) AS worst FROM m a JOIN m z
      ON a.c <> z.c JOIN w wa ON wa.c = a.c JOIN w wb ON wb.c = z.c GROUP BY 1),
    d AS (SELECT p.c, p.x, p.y, m.c = p.c AS own, CASE WHEN m.c = p.c THEN (k * (x * x + y * y) - 2 * k * (x * mx + y * my)
      + sq) / nullif(k - 1, 0) ELSE (x * x + y * y) - 2 * (x * mx + y * my) + sq / k END AS dist FROM p, m),
    q AS (SELECT any_value(i) AS i, max(dist) FILTER (WHERE own) AS a, min(dist) FILTER (WHERE NOT own) AS b FROM
      (SELECT *, x AS i FROM d) GROUP BY c, x, y),
    n AS (SELECT c, x, y, count(*) AS copies FROM p GROUP BY 1, 2, 3),
    s AS (SELECT sum(copies * (b - a) / greatest(a, b)) / sum(copies) AS sil FROM (SELECT c, x, y,
      max(dist) FILTER (WHERE own) AS a, min(dist) FILTER (WHERE NOT own) AS b FROM d GROUP BY 1, 2, 3) JOIN n
      USING (c, x, y))
    SELECT n::BIGINT AS n_samples, 2 AS n_features, clusters::INT AS n_clusters, 0::BIGINT AS n_noise,
      0.0::DOUBLE AS noise_ratio, round(sil, 6) AS silhouette_squared, round((SELECT sum(ss) FROM w), 2) AS inertia,
      round(between / (clusters - 1) / ((SELECT sum(ss) FROM w) / (n - clusters)), 6) AS calinski_harabasz,
      round(db, 4) AS davies_bouldin, CASE WHEN sil > 0.7 THEN 'strong' WHEN sil > 0.5 THEN 'reasonable' WHEN sil > 0.25 THEN 'weak' ELSE 'poor' END
      AS silhouette_interpretation,
      CASE WHEN db < 1 THEN 'good' WHEN db < 2 THEN 'acceptable' ELSE 'poor' END
      AS davies_bouldin_interpretation, CASE WHEN sil > 0.5 THEN 'good' WHEN sil > 0.25 THEN 'fair' ELSE 'poor' END AS overall_quality FROM g, b, s,
      (SELECT avg(worst) AS db FROM r)"""


@query("kmeans_profile", _kmeans("lineitem", _CLUSTER_FEATURES, 4) + _profile(_CLUSTER_FEATURES))
def kmeans_profile(spark, folder):
    labelled = clustering.kmeans(table(spark, folder, "lineitem"), _CLUSTER_FEATURES, k=4)
    return rounded(clustering.cluster_profile(labelled, _CLUSTER_FEATURES))


_PART_FEATURES = ["p_size", "p_retailprice"]


@query(
    "kmeans_chosen_k",
    _kmeans("part", _PART_FEATURES) + ", p AS (SELECT cluster AS c, s0 AS x, s1 AS y FROM labelled)" + _VALIDATION,
)
def kmeans_chosen_k(spark, folder):
    labelled = clustering.kmeans(table(spark, folder, "part"), _PART_FEATURES)
    return rounded(clustering.validate_clusters(labelled, _PART_FEATURES), 6, inertia=2, davies_bouldin=4)


def planted_clusters(spark, folder):
    """Line items with two features that put them into three groups, the planted truth."""
    line = table(spark, folder, "lineitem").withColumn("truth", F.col("l_orderkey") % 3)
    return line.select(
        "truth",
        (F.col("truth") * 1000 + F.col("l_quantity")).alias("far"),
        (F.pmod(F.col("truth") * 2, F.lit(3)) * 10 + F.col("l_discount")).alias("wide"),
    )


@query(
    "kmeans_planted",
    """SELECT dense_rank() OVER (ORDER BY l_orderkey % 3)::INT - 1 AS cluster, l_orderkey % 3 AS truth,
    count(*) AS rows FROM lineitem GROUP BY l_orderkey % 3""",
)
def kmeans_planted(spark, folder):
    """Three groups planted among line items: their number is found, and each comes back whole."""
    labelled = clustering.kmeans(planted_clusters(spark, folder), ["far", "wide"])
    return labelled.groupBy("cluster", "truth").agg(F.count(F.lit(1)).alias("rows"))


def _dbscan(source: str, features: list[str], eps: float, needed: int) -> str:
    """Common tables that end in ``labelled`` (v0 ..., cluster): all pairs of near points, by boxes of side ``eps``."""
    dims = range(len(features))
    points = {"l": 0.01, "a": 0.25, "b": 0.5, "c": 0.75, "h": 0.99}
    side = eps / math.sqrt(len(features)) * (1 - 1e-9)

    def each(template: str, by: str = ", ") -> str:
        return by.join(template.replace("@", str(i)) for i in dims)

    limits = ", ".join(f"quantile_cont(v{i}, {q}) AS {n}{i}" for i in dims for n, q in points.items())
    scaled = each("(least(greatest(v@, l@), h@) - b@) / CASE WHEN c@ = a@ THEN 1 ELSE c@ - a@ END AS s@")
    shifts = ", ".join(f"(SELECT unnest(range(-1, 2)) AS o{i})" for i in dims)
    return f"""WITH RECURSIVE src AS (SELECT {", ".join(f"{f}::DOUBLE AS v{i}" for i, f in enumerate(features))}
      FROM {source} WHERE {" AND ".join(f"{f} IS NOT NULL" for f in features)}),
    lim AS (SELECT {limits} FROM src),
    scaled AS (SELECT {each("least(greatest(v@, l@), h@) AS v@")}, {scaled} FROM src, lim),
    pts AS (SELECT {each("s@")}, count(*) AS w, {each(f"floor(s@ / {side!r})::BIGINT AS c@")},
      {each(f"floor(s@ / {eps!r})::BIGINT AS g@")} FROM scaled GROUP BY {each("s@")}),
    shifted AS (SELECT * EXCLUDE ({each("g@")}), {each("g@ + o@ AS g@")} FROM pts, {shifts}),
    near AS (SELECT {each("a.s@")}, {each("a.c@")}, {each("b.s@ AS t@")}, {each("b.c@ AS d@")}, b.w FROM shifted a
      JOIN pts b ON {each("b.g@ = a.g@", " AND ")} WHERE {each("(a.s@ - b.s@) ** 2", " + ")} <= {eps * eps!r}),
    core AS (SELECT {each("s@")}, {each("c@")} FROM near GROUP BY ALL HAVING sum(w) >= {needed}),
    reached AS (SELECT n.* FROM near n JOIN core c ON {each("c.s@ = n.t@", " AND ")}),
    node AS (SELECT {each("c@")}, row_number() OVER (ORDER BY {each("c@")}) AS id FROM (SELECT DISTINCT {each("c@")} FROM core)),
    edge AS (SELECT DISTINCT a.id AS a, b.id AS b FROM reached r JOIN core c ON {each("c.s@ = r.s@", " AND ")}
      JOIN node a ON {each("a.c@ = r.c@", " AND ")} JOIN node b ON {each("b.c@ = r.d@", " AND ")}),
    part_of(id, low) USING KEY (id) AS (SELECT id, id FROM node UNION
      SELECT e.b, min(p.low) FROM part_of p JOIN edge e ON e.a = p.id JOIN recurring.part_of r ON r.id = e.b
      WHERE p.low < r.low GROUP BY e.b),
    numbered AS (SELECT {each("c@")}, (dense_rank() OVER (ORDER BY low) - 1)::INT AS cluster FROM part_of
      JOIN node USING (id)),
    marked AS (SELECT {each("s@")}, cluster FROM core JOIN numbered USING ({each("c@")}) UNION ALL
      SELECT {each("r.s@")}, min(cluster) FROM reached r JOIN numbered k ON {each("k.c@ = r.d@", " AND ")}
      ANTI JOIN core c ON {each("c.s@ = r.s@", " AND ")} GROUP BY {each("r.s@")}),
    labelled AS (SELECT {each("s.v@")}, coalesce(m.cluster, -1) AS cluster FROM scaled s
      LEFT JOIN marked m ON {each("m.s@ = s.s@", " AND ")})
    """


@query(
    "dbscan_profile",
    _dbscan("part", ["p_size", "p_retailprice"], 0.05, 4)
    + "\nUNION ALL\n".join(
        f"""SELECT cluster, '{name}' AS "column", count(*) AS size, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
        round(count(*) / (SELECT count(*) FROM labelled) * 100, 6) AS percentage, round(median({c}), 6) AS median,
        CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || cluster::VARCHAR END AS cluster_name
        FROM labelled GROUP BY cluster"""
        for c, name in (("v0", "p_size"), ("v1", "p_retailprice"))
    ),
)
def dbscan_profile(spark, folder):
    features = ["p_size", "p_retailprice"]
    labelled = dbscan.dbscan(table(spark, folder, "part"), features, eps=0.05, min_samples=4)
    return rounded(clustering.cluster_profile(labelled, features))


@query(
    "dbscan_line_items",
    _dbscan("lineitem", ["l_quantity", "l_extendedprice"], 0.05, 4)
    + "SELECT cluster, count(*) AS size FROM labelled GROUP BY cluster",
)
def dbscan_line_items(spark, folder):
    features = ["l_quantity", "l_extendedprice"]
    labelled = dbscan.dbscan(table(spark, folder, "lineitem"), features, eps=0.05, min_samples=4)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


@query(
    "dbscan_four_features",
    _dbscan("lineitem", MEASURES, 0.1, 5) + "SELECT cluster, count(*) AS size FROM labelled GROUP BY cluster",
)
def dbscan_four_features(spark, folder):
    """All four measures of line items: more features than index offsets serve."""
    labelled = dbscan.dbscan(table(spark, folder, "lineitem"), MEASURES, eps=0.1, min_samples=5)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def numbered_clusters(spark, folder):
    """Line items labelled by their line number, with features named as the validation expects."""
    line = table(spark, folder, "lineitem")
    return line.select(
        (F.col("l_linenumber") - 1).alias("cluster"),
        *[(F.col(f) * w).alias(clustering.scaled_name(f)) for f, w in (("l_quantity", 0.1), ("l_discount", 10.0))],
    )


@query(
    "cluster_validation",
    """WITH p AS (SELECT l_linenumber - 1 AS c, l_quantity * 0.1 AS x, l_discount * 10.0 AS y FROM lineitem)"""
    + _VALIDATION,
)
def cluster_validation(spark, folder):
    out = clustering.validate_clusters(numbered_clusters(spark, folder), ["l_quantity", "l_discount"])
    return rounded(out, 6, inertia=2, davies_bouldin=4)


@query(
    "cluster_profile",
    union_all(
        """SELECT l_linenumber - 1 AS cluster, '{c}' AS "column", count(*) AS size, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
        round(count(*) / (SELECT count(*) FROM lineitem) * 100, 6) AS percentage, round(median({c}), 6) AS median,
        'cluster_' || (l_linenumber - 1)::VARCHAR AS cluster_name FROM lineitem GROUP BY l_linenumber""",
        ["l_quantity", "l_discount"],
    ),
)
def cluster_profile(spark, folder):
    labelled = table(spark, folder, "lineitem").withColumn("cluster", F.col("l_linenumber") - 1)
    return rounded(clustering.cluster_profile(labelled, ["l_quantity", "l_discount"]))


# --- outliers --------------------------------------------------------------------

_PRICED = "(SELECT *, exp(l_extendedprice / 20000) AS price FROM lineitem)"


def priced_lines(spark, folder):
    return table(spark, folder, "lineitem").withColumn("price", F.exp(F.col("l_extendedprice") / 20000))


@query(
    "iqr_outliers",
    union_all(
        f"""SELECT '{{c}}' AS "column", count(*) FILTER (WHERE {{c}} < a - 1.5 * (b - a) OR {{c}} > b + 1.5 * (b - a))
        AS outlier_count, round(any_value(a - 1.5 * (b - a)), 6) AS lower_bound,
        round(any_value(b + 1.5 * (b - a)), 6) AS upper_bound FROM {_PRICED}, (SELECT quantile_cont({{c}}, 0.25) AS a,
        quantile_cont({{c}}, 0.75) AS b FROM {_PRICED}) HAVING any_value(b - a) > 0""",
        ["l_quantity", "price"],
    ),
)
def iqr_outliers(spark, folder):
    return rounded(anomalies.iqr_summary(priced_lines(spark, folder), ["l_quantity", "price"]))


@query(
    "zscore_outliers",
    union_all(
        f"""SELECT '{{c}}' AS "column", count(*) FILTER (WHERE abs({{c}} - m) / s > 3) AS outlier_count,
        round(max(abs({{c}} - m) / s), 6) AS max_zscore FROM {_PRICED}, (SELECT avg({{c}}) AS m,
        stddev_pop({{c}}) AS s FROM {_PRICED})""",
        ["l_quantity", "price"],
    ),
)
def zscore_outliers(spark, folder):
    return rounded(anomalies.zscore_summary(priced_lines(spark, folder), ["l_quantity", "price"]))


_FLAGGED = f"""(SELECT *, price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) AS iqr, abs(price - m) / s > 3 AS zscore
  FROM {_PRICED}, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, avg(price) AS m,
  stddev_pop(price) AS s FROM {_PRICED}))"""
_BOTH = ["iqr", "zscore"]


@query(
    "outlier_rows",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, iqr, zscore, iqr::INT + zscore::INT AS methods_hit,
    iqr AND zscore AS is_consensus FROM {_FLAGGED} WHERE iqr OR zscore""",
)
def outlier_rows(spark, folder):
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["price"], _BOTH)
    return flagged.where("is_outlier").select(
        "l_orderkey", "l_linenumber", "l_partkey", "iqr", "zscore", "methods_hit", "is_consensus"
    )


@query(
    "outlier_summary",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE iqr) AS iqr, count(*) FILTER (WHERE zscore) AS zscore,
    count(*) FILTER (WHERE iqr OR zscore) AS total_outliers,
    round(count(*) FILTER (WHERE iqr OR zscore) / count(*) * 100, 6) AS outlier_percentage,
    count(*) FILTER (WHERE iqr AND zscore) AS consensus_outliers FROM {_FLAGGED}""",
)
def outlier_summary(spark, folder):
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["price"], _BOTH)
    return rounded(anomalies.outlier_summary(flagged, _BOTH))


@query(
    "outlier_preset_parameters",
    f"""SELECT count(*) FILTER (WHERE iqr) AS iqr, count(*) FILTER (WHERE abs(price - m) / s > 2.5) AS zscore
    FROM {_FLAGGED}""",
)
def outlier_preset_parameters(spark, folder):
    flagged = anomalies.detect_outliers(
        priced_lines(spark, folder), ["price"], _BOTH, **anomalies.PRESETS["iqr"], **anomalies.PRESETS["zscore"]
    )
    return flagged.agg(*[F.count_if(m).alias(m) for m in _BOTH])


@query(
    "outlier_sample",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {_FLAGGED} WHERE iqr OR zscore
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""",
)
def outlier_sample(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["price"], _BOTH)
    return anomalies.outlier_sample(flagged, keys).select(*keys)


@query(
    "outlier_assumptions",
    union_all(
        """SELECT '{c}' AS "column", count({c}) AS data_points, 0.0::DOUBLE AS missing_percentage,
        count(DISTINCT {c}) AS unique_values, 'anderson_darling' AS test,
        CASE WHEN count(DISTINCT {c}) = 1 THEN 'no_variance' WHEN count(DISTINCT {c}) = 2 THEN 'very_low_variance'
        ELSE '' END AS warnings FROM lineitem""",
        MEASURES,
    ),
)
def outlier_assumptions(spark, folder):
    """Columns hold over 5000 values, so each is tested by Anderson-Darling."""
    found = anomalies.check_assumptions(table(spark, folder, "lineitem"), MEASURES)
    return found.select("column", "data_points", "missing_percentage", "unique_values", "test", "warnings")


@query("outliers_isolation_forest")
def outliers_isolation_forest(spark, folder):
    methods = ("iqr", "zscore", "isolation_forest")
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["l_quantity", "price"], methods)
    return rounded(anomalies.outlier_summary(flagged, methods))


@query("outliers_elliptic_envelope")
def outliers_elliptic_envelope(spark, folder):
    methods = ("zscore", "elliptic_envelope")
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["l_quantity", "price"], methods)
    return rounded(anomalies.outlier_summary(flagged, methods))


@query("multivariate_anomalies")
def multivariate_anomalies(spark, folder):
    found = anomalies.multivariate_anomalies(table(spark, folder, "lineitem"), MEASURES, 0.05)
    return rounded(anomalies.anomaly_score_summary(found, 0.05))


@query(
    "anomaly_characteristics",
    union_all(
        f"""SELECT '{{c}}' AS "column", round(avg({{c}}), 5) AS all_mean, round(stddev_samp({{c}}), 5) AS all_std,
        round(avg({{c}}) FILTER (WHERE zscore), 5) AS anomaly_mean,
        round(stddev_samp({{c}}) FILTER (WHERE zscore), 5) AS anomaly_std, round(median({{c}}), 5) AS all_median,
        round(median({{c}}) FILTER (WHERE zscore), 5) AS anomaly_median,
        round(abs(avg({{c}}) FILTER (WHERE zscore) - avg({{c}})), 5) AS mean_deviation,
        round(abs(stddev_samp({{c}}) FILTER (WHERE zscore) - stddev_samp({{c}})), 5) AS std_deviation,
        abs(avg({{c}}) FILTER (WHERE zscore) - avg({{c}})) > 2 * stddev_samp({{c}}) AS is_extreme FROM {_FLAGGED}""",
        ["l_quantity", "price"],
    ),
)
def anomaly_characteristics(spark, folder):
    flagged = anomalies.detect_outliers(priced_lines(spark, folder), ["price"], ["zscore"])
    return rounded(anomalies.anomaly_characteristics(flagged, ["l_quantity", "price"], "zscore"), 5)


RULES = [
    {"type": "range", "column": "o_totalprice", "min": 1000, "max": 400000},
    {"type": "categorical", "column": "o_orderstatus", "valid_values": ["O", "F"]},
    {"type": "null_check", "column": "o_orderdate"},
    {"type": "pattern", "column": "o_orderpriority", "pattern": "[1-3]-"},
    {"type": "custom", "column": "o_custkey", "condition": "o_custkey > 0"},
]
_TESTS = [
    "o_totalprice < 1000 OR o_totalprice > 400000",
    "o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')",
    "o_orderdate IS NULL",
    "o_orderpriority IS NULL OR NOT regexp_matches(o_orderpriority, '^(?:[1-3]-)')",
    "false",
]


@query(
    "rule_anomalies",
    "SELECT o_orderkey, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {t} THEN {i} END" for i, t in enumerate(_TESTS))
    + "], lambda r: r IS NOT NULL), ',') AS violated_rules FROM orders WHERE "
    + " OR ".join(f"({t})" for t in _TESTS),
)
def rule_anomalies(spark, folder):
    found = anomalies.rule_anomalies(table(spark, folder, "orders"), RULES)
    return found.select("o_orderkey", F.array_join("violated_rules", ",").alias("violated_rules"))


@query(
    "rule_summary",
    " UNION ALL ".join(
        f"""SELECT {i} AS rule_id, '{k}' AS type, '{c}' AS "column", count(*) FILTER (WHERE {t}) AS violation_count,
        round(count(*) FILTER (WHERE {t}) / count(*) * 100, 6) AS violation_percentage FROM orders"""
        for i, k, c, t in [
            (-1, "any", "", " OR ".join(f"({t})" for t in _TESTS)),
            *[(i, r["type"], r["column"], t) for i, (r, t) in enumerate(zip(RULES, _TESTS))],
        ]
    ),
)
def rule_summary(spark, folder):
    return rounded(anomalies.rule_summary(table(spark, folder, "orders"), RULES))


# --- series ----------------------------------------------------------------------

@query(
    "series_anomalies",
    """SELECT event_id, round(m, 6) AS rolling_mean, round(z, 6) AS z_score, coalesce(abs(z) > 2, false) AS is_anomaly
    FROM (SELECT *, (value - m) / nullif(s, 0) AS z FROM (SELECT event_id, value,
      CASE WHEN k = 30 THEN a END AS m, CASE WHEN k = 30 THEN d END AS s FROM (SELECT event_id, value,
      avg(value) OVER w AS a, stddev_samp(value) OVER w AS d, count(*) OVER w AS k FROM events
      WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING))))""",
)
def series_anomalies(spark, folder):
    found = anomalies.series_anomalies(table(spark, folder, "events"), "ts", "value", ["event_id"])
    return rounded(found.select("event_id", "rolling_mean", "z_score", "is_anomaly"))


@query(
    "series_anomalies_by_user",
    """WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts,
      event_id) AS i FROM events),
    s AS (SELECT *, CASE WHEN n > 30 THEN least(30, n // 4) ELSE greatest(3, n // 3) END AS w FROM e WHERE n >= 10),
    j AS (SELECT a.event_id, a.user_id, any_value(a.value) AS value, any_value(a.w) AS w, count(*) AS k,
      avg(b.value) AS m, stddev_samp(b.value) AS d FROM s a JOIN s b ON a.user_id = b.user_id
      AND b.i BETWEEN a.i - (a.w - 1 - (a.w - 1) // 2) AND a.i + (a.w - 1) // 2 GROUP BY 1, 2)
    SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE k = w AND abs((value - m) / nullif(d, 0)) > 2) AS anomaly_count,
      round(count(*) FILTER (WHERE k = w AND abs((value - m) / nullif(d, 0)) > 2) / count(*) * 100, 6) AS anomaly_percentage,
      round(avg(value), 9) AS mean_value, round(stddev_samp(value), 6) AS std_value,
      round(coalesce(max(abs((value - m) / nullif(d, 0))) FILTER (WHERE k = w), 0), 6) AS max_z_score FROM j GROUP BY 1""",
)
def series_anomalies_by_user(spark, folder):
    found = anomalies.series_anomalies(table(spark, folder, "events"), "ts", "value", ["event_id"], ["user_id"])
    return rounded(anomalies.series_anomaly_summary(found, "value", ["user_id"]), 6, mean_value=9)


@query(
    "series_features",
    """SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS day_of_week, day(ts)::INT AS day_of_month,
      month(ts)::INT AS month, lag(value, 1) OVER o AS lag_1, lag(value, 7) OVER o AS lag_7, lag(value, 30) OVER o AS lag_30,
      round(CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END, 6) AS rolling_mean,
      round(CASE WHEN count(*) OVER w = 7 THEN stddev_samp(value) OVER w END, 6) AS rolling_std FROM events
    WINDOW o AS (ORDER BY ts, event_id), w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def series_features(spark, folder):
    found = anomalies.series_features(table(spark, folder, "events"), "ts", "value", ["event_id"])
    return rounded(
        found.select("event_id", "hour", "day_of_week", "day_of_month", "month", "lag_1", "lag_7", "lag_30",
                     "rolling_mean", "rolling_std")
    )


@query("series_forest_anomalies")
def series_forest_anomalies(spark, folder):
    found = anomalies.series_forest_anomalies(table(spark, folder, "events"), "ts", "value", ["event_id"])
    return rounded(anomalies.anomaly_score_summary(found))


def _resample_sql(unit: str, step: str, label: str) -> str:
    return f"""WITH b AS (SELECT date_trunc('{unit}', o_orderdate)::TIMESTAMP AS p, count(*) AS n, avg(o_totalprice) AS m,
      sum(o_totalprice) AS s FROM orders GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(p) FROM b), (SELECT max(p) FROM b), INTERVAL {step})) AS p),
    r AS (SELECT row_number() OVER (ORDER BY p) - 1 AS position, {label} AS period, coalesce(n, 0) AS "count",
      coalesce(m, 0) AS mean, coalesce(s, 0) AS sum FROM g LEFT JOIN b USING (p))"""


_END = "(p + INTERVAL {s} - INTERVAL 1 DAY)::TIMESTAMP"
_STEPS = {
    "D": ("day", "1 DAY", "p"),
    "W": ("week", "7 DAY", _END.format(s="7 DAY")),
    "ME": ("month", "1 MONTH", _END.format(s="1 MONTH")),
    "QE": ("quarter", "3 MONTH", _END.format(s="3 MONTH")),
    "YE": ("year", "1 YEAR", _END.format(s="1 YEAR")),
}


def _register_resample(code: str) -> None:
    digits = 7 if code == "W" else 6
    sql = _resample_sql(*_STEPS[code]) + f""" SELECT position, period, "count", round(mean, {digits}) AS mean,
      round(sum, 2) AS sum FROM r"""

    @query(f"resample_{code.lower()}", sql)
    def resample(spark, folder):
        out = timeseries.resample(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", code)
        return rounded(out, digits, sum=2)


for _code in _STEPS:
    _register_resample(_code)


@query(
    "resample_hourly",
    """WITH b AS (SELECT date_trunc('hour', ts) AS p, count(*) AS n, avg(value) AS m, sum(value) AS s FROM events GROUP BY 1),
    g AS (SELECT unnest(generate_series((SELECT min(p) FROM b), (SELECT max(p) FROM b), INTERVAL 1 HOUR)) AS p)
    SELECT row_number() OVER (ORDER BY p) - 1 AS position, p AS period, coalesce(n, 0) AS "count",
      round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 4) AS sum FROM g LEFT JOIN b USING (p)""",
)
def resample_hourly(spark, folder):
    return rounded(timeseries.resample(table(spark, folder, "events"), "ts", "value", "h"), 6, sum=4)


_TREND_OUT = """ SELECT count(*) AS total_periods, round(regr_slope(mean, position), 6) AS slope,
  round(corr(mean, position), 8) AS correlation, CASE WHEN regr_slope(mean, position) > 0 THEN 'increasing'
  WHEN regr_slope(mean, position) < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  round(abs(corr(mean, position)), 8) AS strength, round(avg(mean), 4) AS average_value, round(sum(sum), 1) AS total_sum,
  arg_max(period, mean) AS peak_period, round(max(mean), 4) AS peak_value FROM r"""


@query("trend_analysis", _resample_sql(*_STEPS["ME"]) + _TREND_OUT)
def trend_analysis(spark, folder):
    out = timeseries.trend_analysis(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "M")
    return rounded(out, 4, slope=6, correlation=8, strength=8, total_sum=1)


@query("find_trend", _resample_sql(*_STEPS["QE"]) + _TREND_OUT)
def find_trend(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice"
    )
    return rounded(timeseries.find_trend(df, "Q"), 4, slope=6, correlation=8, strength=8, total_sum=1)


@query(
    "series_patterns",
    union_all(
        f"""SELECT '{{c}}' AS "column", n, CASE WHEN abs(slope) < se THEN 'flat' WHEN slope > 0 THEN 'increasing'
        ELSE 'decreasing' END AS direction, round(slope, 8) AS slope, round(abs(r), 8) AS strength,
        round(p, 8) AS p_value, p < 0.05 AS significant, round(sd, 6) AS volatility, lo AS min, hi AS max,
        round(hi - lo, 6) AS span FROM (SELECT *, {_R_P} AS p, sqrt((1 - r * r) * yy / xx / (n - 2)) AS se FROM (
        SELECT count(*) AS n, regr_slope(y, x) AS slope, corr(y, x) AS r, var_pop(y) AS yy, var_pop(x) AS xx,
        stddev_samp(y) AS sd, min(y) AS lo, max(y) AS hi FROM (SELECT {{c}}::DOUBLE AS y,
        row_number() OVER (ORDER BY ts, event_id) - 1 AS x FROM events)))""",
        ["value", "user_id"],
    ),
)
def series_patterns(spark, folder):
    out = timeseries.series_patterns(table(spark, folder, "events"), "ts", ["value", "user_id"], ["event_id"])
    return rounded(out, 6, slope=8, strength=8, p_value=8)


_CYCLES = [("monthly", "month(ts)"), ("weekly", "isodow(ts) - 1"), ("hourly", "hour(ts)")]


@query(
    "seasonality",
    " UNION ALL ".join(
        f"""SELECT 'value' AS "column", '{n}' AS cycle, count(*) AS buckets, round(var_samp(m), 6) AS variance,
        round((SELECT var_samp(value) FROM events), 6) AS total_variance,
        var_samp(m) > (SELECT var_samp(value) FROM events) * 0.1 AS has_pattern
        FROM (SELECT avg(value) AS m FROM events GROUP BY {e}) HAVING count(*) > 1"""
        for n, e in _CYCLES
    ),
)
def seasonality(spark, folder):
    return rounded(timeseries.seasonality(table(spark, folder, "events"), "ts", ["value"]))


@query(
    "bucket_means",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS cycle, ({e})::INT AS bucket, count(*) AS "count", round(avg(value), 6) AS mean FROM events
        GROUP BY 2""" for n, e in _CYCLES
    ),
)
def bucket_means(spark, folder):
    return rounded(timeseries.bucket_means(table(spark, folder, "events"), "ts", "value"))


@query(
    "monthly_statistics",
    """SELECT month(l_shipdate)::INT AS month, round(avg(l_discount), 6) AS mean, count(*) AS "count",
    round(stddev_samp(l_discount), 6) AS std FROM lineitem WHERE l_discount > 0 GROUP BY 1""",
)
def monthly_statistics(spark, folder):
    return rounded(timeseries.monthly_statistics(table(spark, folder, "lineitem"), "l_shipdate", "l_discount"))


_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in timeseries.MONTH_NAMES) + "]"
_PEAKS = f"""sum(n)::BIGINT AS rows_used, {_MONTH_LIST}[arg_max(mo, mean)] AS peak_month,
  {_MONTH_LIST}[arg_min(mo, mean)] AS low_month, round(max(mean), 4) AS peak_volume, round(min(mean), 4) AS low_volume,
  round((max(mean) - min(mean)) / avg(mean) * 100, 6) AS seasonal_variation"""


@query(
    "seasonal_pattern",
    f"""SELECT {_PEAKS} FROM (SELECT month(l_shipdate) AS mo, avg(l_extendedprice) AS mean, count(*) AS n FROM lineitem
    WHERE l_extendedprice > 0 GROUP BY 1) HAVING count(*) >= 12""",
)
def seasonal_pattern(spark, folder):
    out = timeseries.seasonal_pattern(table(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice")
    return rounded(out, 4, seasonal_variation=6)


@query(
    "seasonal_pattern_of_picked_columns",
    f"""SELECT {_PEAKS} FROM (SELECT month(l_shipdate) AS mo, avg(l_quantity) AS mean, count(*) AS n FROM lineitem
    WHERE l_quantity > 0 GROUP BY 1) HAVING count(*) >= 12""",
)
def seasonal_pattern_of_picked_columns(spark, folder):
    line = table(spark, folder, "lineitem")
    return rounded(timeseries.seasonal_pattern(line, *timeseries.pick_seasonal_columns(line)), 4, seasonal_variation=6)


@query("seasonal_test")
def seasonal_test(spark, folder):
    return rounded(timeseries.seasonal_test(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity"))


@query(
    "seasonal_by_category",
    f"""SELECT l_returnflag AS category, {_PEAKS} FROM (SELECT l_returnflag, month(l_shipdate) AS mo,
      avg(seasonal) AS mean, count(*) AS n FROM (SELECT *, l_quantity * (1 + month(l_shipdate)) AS seasonal FROM lineitem)
      WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2) GROUP BY 1
    HAVING count(*) >= 12 AND sum(n) >= 1000 AND (max(mean) - min(mean)) / avg(mean) * 100 > 20""",
)
def seasonal_by_category(spark, folder):
    line = table(spark, folder, "lineitem").withColumn(
        "seasonal", F.col("l_quantity") * (1 + F.month("l_shipdate"))
    )
    out = timeseries.seasonal_by_category(line, "l_shipdate", "seasonal", "l_returnflag", ["A", "N"])
    return rounded(out, 4, seasonal_variation=6)


# --- drivers and bottlenecks -----------------------------------------------------

_LOADED = """(SELECT l_extendedprice + 2000 * l_quantity AS load, l_quantity, l_extendedprice, l_discount, l_returnflag,
  l_linestatus FROM lineitem)"""


def loaded_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") + 2000 * F.col("l_quantity")).alias("load"), "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus",
    )


_NUMERIC_DRIVERS = f"""SELECT factor, round(r, 8) AS correlation, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS relationship,
      CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS strength, n AS sample_size,
      round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 8) AS ci_lower,
      round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 8) AS ci_upper FROM ({union_all(
          f"SELECT '{{c}}' AS factor, corr(load, {{c}}) AS r, count(*) AS n FROM {_LOADED}",
          ["l_quantity", "l_extendedprice", "l_discount"])}) WHERE n >= 30 AND abs(r) >= 0.3"""


@query("numeric_drivers", _NUMERIC_DRIVERS)
def numeric_drivers(spark, folder):
    return rounded(drivers.numeric_drivers(loaded_lines(spark, folder)), 8)


def _driver_test(group: str) -> str:
    rows = _stacked(["load"], _LOADED, group)
    spread = f'SELECT "column", grp, abs(v - median(v) OVER (PARTITION BY "column", grp)) AS v FROM ({rows})'
    f_of = lambda core: f"(SELECT *, (between / (groups - 1)) / (inner_ss / (n - groups)) AS f FROM ({_anova_core(core)}))"
    p_of = sqlmath.f_tail("f", "(groups - 1)", "(n - groups)")
    met = "lp > 0.05 AND np > 0.05"
    return f"""SELECT '{group}' AS factor, CASE WHEN {met} THEN 'anova' ELSE 'kruskal_wallis' END AS test,
      CASE WHEN {met} THEN f ELSE h END AS statistic, CASE WHEN {met} THEN fp ELSE hp END AS p_value
      FROM (SELECT f, {p_of} AS fp FROM {f_of(rows)}), (SELECT {p_of} AS lp FROM {f_of(spread)}),
      (SELECT statistic AS h, p_value AS hp FROM ({_kruskal(rows)})), (SELECT np FROM ({_anderson(rows)}))"""


_DRIVER_TESTS = _driver_test("l_returnflag") + " UNION ALL " + _driver_test("l_linestatus")


@query(
    "category_drivers",
    f"""SELECT factor, test, round(statistic, 6) AS statistic, round(p_value, 8) AS p_value,
    round(p_value_corrected, 8) AS p_value_corrected, significant_corrected FROM ({_bh(_DRIVER_TESTS)})""",
)
def category_drivers(spark, folder):
    out = drivers.category_drivers(loaded_lines(spark, folder)).select(
        "factor", "test", "statistic", "p_value", "p_value_corrected", "significant_corrected"
    )
    return rounded(out, 8, statistic=6)


@query(
    "all_drivers",
    f"""SELECT factor, 'correlation' AS kind, round(correlation, 6) AS measure, NULL::DOUBLE AS p_value
      FROM ({_NUMERIC_DRIVERS})
    UNION ALL SELECT factor, 'group_difference', round(statistic, 6), round(p_value, 6) FROM ({_bh(_DRIVER_TESTS)})
      WHERE significant_corrected""",
)
def all_drivers(spark, folder):
    return rounded(drivers.all_drivers(loaded_lines(spark, folder)))


@query(
    "driver_confidence",
    f"""SELECT count(*) AS tests, count(*) FILTER (WHERE significant_corrected) AS significant_tests,
    CASE WHEN count(*) FILTER (WHERE significant_corrected) >= 2 THEN 'high'
    WHEN count(*) FILTER (WHERE significant_corrected) = 1 THEN 'medium' ELSE 'low' END AS confidence
    FROM ({_bh(_DRIVER_TESTS)})""",
)
def driver_confidence(spark, folder):
    return drivers.driver_confidence(drivers.category_drivers(loaded_lines(spark, folder)))


def _bottleneck(columns: list[str], source: str) -> str:
    return union_all(
        f"""SELECT '{{c}}' AS metric, k AS bottleneck_instances, round(t, 4) AS threshold, round(sev, 6) AS severity_ratio,
        round(mn, 4) AS mean_normal, round(mb, 4) AS mean_bottleneck, round(mx, 4) AS max_observed,
        round(k / n * 100, 6) AS frequency_pct, round(sev * k / n, 8) AS bottleneck_score FROM (SELECT *,
        coalesce((mb - mn) / nullif(mn, 0), 0) AS sev FROM (SELECT count(*) AS n, any_value(t) AS t, count(*) FILTER
        (WHERE {{c}} > t) AS k, avg({{c}}) FILTER (WHERE {{c}} <= q3) AS mn, avg({{c}}) FILTER (WHERE {{c}} > t) AS mb,
        max({{c}}) AS mx FROM {source}, (SELECT quantile_cont({{c}}, 0.75) AS q3, quantile_cont({{c}}, 0.75) + 1.5
        * (quantile_cont({{c}}, 0.75) - quantile_cont({{c}}, 0.25)) AS t FROM {source}))) WHERE k > 0""",
        columns,
    )


@query("bottlenecks", _bottleneck(["flow", "l_quantity"], f"(SELECT price AS flow, l_quantity FROM {_PRICED})"))
def bottlenecks(spark, folder):
    df = priced_lines(spark, folder).select(F.col("price").alias("flow"), "l_quantity")
    return rounded(drivers.bottlenecks(df, ["flow", "l_quantity"]), 4, severity_ratio=6, frequency_pct=6, bottleneck_score=8)


@query(
    "bottlenecks_most_variable",
    _bottleneck(["price", "l_extendedprice"], f"(SELECT price, l_extendedprice, 1.0 AS fixed FROM {_PRICED})"),
)
def bottlenecks_most_variable(spark, folder):
    df = priced_lines(spark, folder).select("price", "l_extendedprice", F.lit(1.0).alias("fixed"))
    return rounded(drivers.bottlenecks(df), 4, severity_ratio=6, frequency_pct=6, bottleneck_score=8)


@query(
    "sample_rows",
    """SELECT l_returnflag, count(*) AS n FROM lineitem
    WHERE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8))::BIGINT
          < 429496729 GROUP BY 1""",
)
def sample_rows(spark, folder):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sampled = readers.sample_rows(table(spark, folder, "lineitem"), 0.1, keys=keys)
    return sampled.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
