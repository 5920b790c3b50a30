"""Planted truth, brute force and invariants for operators SQL cannot state."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog.registry import table
from tidemark.operators import (
    aggregate, anomalies, bootstrap, cleaning, clustering, correlation, dbscan, derive, describe, envelope, filters, forest,
    hypothesis, profile, quality, timeseries,
)
from tidemark.operators.kendall import kendall


def frame(spark, data: dict):
    return spark.createDataFrame(pd.DataFrame(data))


# --- filters ---------------------------------------------------------------------


def test_not_equals_keeps_nulls_and_others_drop_them(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", None)], "k string, x int")
    keep = lambda *spec: filters.apply_filters(df, [dict(zip(("column", "operator", "value"), spec))]).count()
    assert keep("k", "not_equals", "a") == 2
    assert keep("k", "equals", "a") == 1
    assert keep("x", "greater_equal", 1) == 2
    assert keep("missing_column", "equals", 1) == 3
    assert keep("x", "contains", "1") == 3
    with pytest.raises(ValueError):
        keep("x", "resembles", 1)


def test_accounting_matches_the_filtered_table(spark, folder):
    line = table(spark, folder, "lineitem")
    specs = [
        {"column": "l_quantity", "operator": "less_equal", "value": 20},
        {"column": "l_tax", "operator": "greater_than", "value": 0.02},
    ]
    last = filters.filter_accounting(line, specs).orderBy("step").collect()[-1]
    assert last["rows_after"] == filters.apply_filters(line, specs).count()


def test_filters_reach_the_scan(spark, folder, capsys):
    plain = spark.read.parquet(f"{folder}/lineitem.parquet")
    filters.apply_filters(plain, {"l_quantity": {"min": 45}}).select("l_orderkey").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


# --- tests of hypotheses ---------------------------------------------------------


def test_kendall_across_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 25, 300), rng.integers(0, 40, 300)
    y = y + x // 2
    df = frame(spark, {"x": x, "y": y})
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    want = (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())
    for block_rows in (10, 57, 100_000):
        got = kendall(df, ["x", "y"], block_rows=block_rows).first()
        assert got["correlation"] == pytest.approx(want, abs=1e-12)


def test_rank_correlations_drop_incomplete_pairs(spark):
    data = {"x": [1.0, 2, 3, 4, 5, None], "y": [2.0, 1, 4, 3, None, 9], "z": [6.0, 5, 4, 3, 2, 1]}
    found = {
        (r["column1"], r["column2"]): (r["sample_size"], r["correlation"])
        for r in correlation.spearman(frame(spark, data)).collect()
    }
    assert found[("x", "y")][0] == 4 and found[("x", "z")] == (5, pytest.approx(-1.0))
    pair = pd.DataFrame(data)[["x", "y"]].dropna().rank().corr().iloc[0, 1]
    assert found[("x", "y")][1] == pytest.approx(pair)


def test_both_spearman_routes_agree(spark, folder):
    line = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    one = correlation._rank_sums(line, line.columns).orderBy("pair").toPandas()
    two = correlation._rank_sums_complete(line, line.columns).orderBy("pair").toPandas()
    assert np.allclose(one[["uv", "uu", "vv"]], two[["uv", "uu", "vv"]])


def test_yates_table_with_empty_diagonal(spark):
    df = frame(spark, {"a": ["x"] * 6 + ["y"] * 6, "b": ["p"] * 6 + ["q"] * 6})
    got = correlation.cramers_v_pairs(df, ["a", "b"]).first()
    # Four cells with expected 3 and observed 6 or 0: (3 - 0.5)^2 / 3 each.
    assert got["chi2_statistic"] == pytest.approx(4 * 2.5**2 / 3)
    assert got["degrees_of_freedom"] == 1


def test_parametric_choice_and_effect_sizes(spark):
    rng = np.random.default_rng(42)
    groups = np.repeat(["a", "b", "c"], 80)
    shift = {"a": 0.0, "b": 0.7, "c": 0.0}
    values = rng.normal(size=240) + np.array([shift[g] for g in groups])
    df = frame(spark, {"g": groups, "v": values})
    got = hypothesis.compare_groups(df, "g", ["v"]).first()
    assert got["test"] == "anova" and got["significant"] and got["effect_measure"] == "eta_squared"
    d = {(r["group1"], r["group2"]): r["cohens_d"] for r in hypothesis.pairwise_t_tests(df, "g", ["v"]).collect()}
    assert 0.3 < abs(d[("a", "b")]) < 1.2
    skewed = df.withColumn("v", F.exp(2 * F.col("v")))
    assert hypothesis.compare_groups(skewed, "g", ["v"]).first()["test"] == "kruskal_wallis"


def test_small_exact_mann_whitney(spark):
    df = frame(spark, {"g": ["a"] * 3 + ["b"] * 3, "v": [1.0, 2, 3, 4, 5, 6]})
    got = hypothesis.pairwise_mann_whitney(df, "g", "v").first()
    assert got["statistic"] == 0.0
    assert got["p_value"] == pytest.approx(0.1)
    assert got["rank_biserial"] == pytest.approx(1.0)


def test_two_groups_pick_the_test(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, {"g": ["a"] * 60 + ["b"] * 60, "v": np.r_[rng.normal(0, 1, 60), rng.normal(1, 1, 60)]})
    got = hypothesis.compare_two_groups(df, "g", "a", "b", "v").first()
    assert got["test"] == "t_test" and got["significant"] and got["ci_lower"] < got["mean_difference"] < got["ci_upper"]


def test_benjamini_hochberg_known_values(spark):
    df = frame(spark, {"i": range(5), "p_value": [0.01, 0.04, 0.03, 0.005, 0.8]})
    got = {r["i"]: r["p_value_corrected"] for r in hypothesis.benjamini_hochberg(df).collect()}
    assert got == pytest.approx({0: 0.025, 1: 0.05, 2: 0.05, 3: 0.025, 4: 0.8})


def test_bootstrap_interval_brackets_the_median(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(10, 2, 400)
    df = frame(spark, {"g": ["a"] * 400, "v": values})
    got = bootstrap.median_intervals(df, "g", ["v"]).first()
    assert got["ci_lower"] < np.median(values) < got["ci_upper"]
    real = [np.median(rng.choice(values, 400)) for _ in range(4000)]
    assert got["ci_lower"] == pytest.approx(np.percentile(real, 2.5), abs=0.12)
    assert got["ci_upper"] == pytest.approx(np.percentile(real, 97.5), abs=0.12)
    again = bootstrap.median_intervals(df.repartition(9), "g", ["v"]).first()
    assert got == again


# --- mining ----------------------------------------------------------------------


def brute_dbscan(points, eps, min_samples):
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    label, k = -np.ones(len(points), int), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = k
                        stack.append(j)
            k += 1
    allowed = [{label[i]} if core[i] else set(label[np.flatnonzero(near[i] & core)]) for i in range(len(points))]
    return core, label, allowed


@pytest.mark.parametrize("direct,chunk", [(10_000, 10_000), (5, 7)])
def test_dbscan_equals_brute_force(spark, monkeypatch, direct, chunk):
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(dbscan, "CHUNK_POINTS", chunk)
    rng = np.random.default_rng(0)
    points = np.vstack(
        [
            rng.normal(0, 0.3, (80, 2)),
            rng.normal(3, 0.4, (80, 2)),
            rng.uniform(-3, 6, (60, 2)),
            np.repeat(rng.normal(0, 0.3, (1, 2)), 80, axis=0),
        ]
    )
    df = frame(spark, {"i": range(len(points)), "a": points[:, 0], "b": points[:, 1]})
    rows = dbscan.label_dense_regions(df, ["a", "b"], 0.3, 4).orderBy("i").collect()
    got = np.array([r["cluster"] for r in rows])
    core, label, allowed = brute_dbscan(points, 0.3, 4)
    name = {}
    for i in np.flatnonzero(core):
        assert name.setdefault(label[i], got[i]) == got[i]
    assert len(set(name.values())) == len(name)
    for i in np.flatnonzero(~core):
        wanted = {name[k] for k in allowed[i]}
        assert got[i] in wanted if wanted else got[i] == -1


def test_kmeans_finds_separated_groups(spark):
    rng = np.random.default_rng(42)
    a = np.vstack([rng.normal(m, 0.2, (60, 2)) for m in (0, 5, 10)])
    df = frame(spark, {"truth": np.repeat([0, 1, 2], 60), "x": a[:, 0], "y": a[:, 1]})
    labelled = clustering.kmeans(df, ["x", "y"], k=3)
    assert labelled.groupBy("truth").agg(F.count_distinct("cluster").alias("k")).where("k > 1").count() == 0
    quality_row = clustering.validate_clusters(labelled, ["x", "y"]).first()
    assert quality_row["n_clusters"] == 3 and quality_row["silhouette_squared"] > 0.9
    assert quality_row["overall_quality"] == "good"


def planted(spark, n=400):
    rng = np.random.default_rng(3)
    x, y = rng.normal(50, 10, n), rng.normal(0, 1, n)
    x[:5], y[:5] = [300, 280, -200, -240, 320], [12, -15, 14, -11, 13]
    return frame(spark, {"id": range(n), "x": x, "y": y})


def test_forest_and_envelope_find_planted_outliers(spark):
    df = planted(spark)
    for model in (forest.isolation_forest, envelope.elliptic_envelope):
        found = model(df, ["x", "y"], ["id"], contamination=0.02)
        hit = {r["id"] for r in found.where("is_anomaly").collect()}
        assert set(range(5)) <= hit
        assert len(hit) == pytest.approx(8, abs=1)


def test_forest_does_not_depend_on_row_order(spark):
    df = planted(spark)
    one = {r["id"]: r["score"] for r in forest.isolation_forest(df.repartition(1), ["x", "y"], ["id"]).collect()}
    two = {r["id"]: r["score"] for r in forest.isolation_forest(df.repartition(6), ["x", "y"], ["id"]).collect()}
    assert one == pytest.approx(two)


def test_forest_samples_from_large_tables(spark, folder):
    line = table(spark, folder, "lineitem")
    model = forest.fit_forest(line, ["l_quantity", "l_tax"], line.columns, trees=10, sample=64)
    assert model.feature.shape[0] == 10 and model.sample == 64
    assert ((model.score(np.array([[25.0, 0.04], [500.0, 3.0]]))) > 0).all()


def test_outlier_methods_and_consensus(spark):
    flagged = anomalies.detect_outliers(planted(spark), ["x", "y"], anomalies.METHODS, ["id"], contamination=0.02)
    consensus = {r["id"] for r in flagged.where("is_consensus").collect()}
    assert set(range(5)) <= consensus
    with pytest.raises(ValueError):
        anomalies.detect_outliers(planted(spark), ["x"], ["guess"])


def test_incomplete_rows_are_never_anomalies(spark):
    df = planted(spark).withColumn("x", F.when(F.col("id") != 7, F.col("x")))
    found = forest.isolation_forest(df, ["x", "y"], ["id"])
    assert found.count() == 400
    row = found.where("id = 7").first()
    assert row["score"] is None and row["is_anomaly"] is False


def test_rules_treat_nulls_as_documented(spark):
    df = spark.createDataFrame([(1, "A1", 5.0), (2, None, None), (3, "zA", 50.0)], "id int, code string, x double")
    rules = [
        {"type": "range", "column": "x", "max": 10},
        {"type": "categorical", "column": "code", "valid_values": ["A1"]},
        {"type": "null_check", "column": "x"},
        {"type": "pattern", "column": "code", "pattern": "A"},
        {"type": "custom", "column": "x", "condition": "x > 0"},
    ]
    found = {r["id"]: r["violated_rules"] for r in anomalies.rule_anomalies(df, rules).collect()}
    assert found == {2: [1, 2, 3], 3: [0, 1, 3]}


# --- series, quality, cleaning ---------------------------------------------------


def test_seasonal_series_is_recognised(spark):
    days = pd.date_range("2022-01-01", periods=365)
    t = np.arange(365)
    noise = np.random.default_rng(4).normal(size=365)
    df = frame(spark, {"day": days, "value": 100 + 10 * np.sin(2 * np.pi * t / 365) + 0.01 * t + noise})
    monthly = timeseries.seasonality(df, "day", ["value"]).where("cycle = 'monthly'").first()
    assert monthly["has_pattern"]
    pattern = timeseries.seasonal_pattern(df, "day", "value").first()
    assert pattern["peak_month"] in ("March", "April") and pattern["low_month"] in ("September", "October")
    assert timeseries.seasonal_test(df, "day", "value", min_rows=20).first()["significant"]


def test_empty_periods_count_as_zero(spark):
    df = frame(spark, {"day": pd.to_datetime(["2024-01-31", "2024-01-15", "2024-04-02"]), "v": [1.0, 3.0, 5.0]})
    rows = timeseries.resample(df, "day", "v", "ME").orderBy("position").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 1]
    assert [str(r["period"])[:10] for r in rows] == ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30"]


def test_series_spike_is_found(spark):
    values = np.sin(np.arange(200) / 5.0)
    values[120] = 9.0
    df = frame(spark, {"at": pd.date_range("2024-01-01", periods=200, freq="h"), "i": range(200), "v": values})
    found = anomalies.series_anomalies(df, "at", "v", ["i"])
    assert 120 in {r["i"] for r in found.where("is_anomaly").collect()}
    scored = anomalies.series_forest_anomalies(df, "at", "v", ["i"])
    assert 120 in {r["i"] for r in scored.where("is_anomaly").collect()}


def test_duplicates_and_fingerprint(spark, folder):
    part = table(spark, folder, "part")
    doubled = part.union(part).union(part.limit(0))
    assert aggregate.duplicate_rows(doubled).first()[0] == part.count()
    assert profile.table_fingerprint(part).first() == profile.table_fingerprint(part.repartition(5)).first()
    assert profile.table_fingerprint(part).first() != profile.table_fingerprint(doubled).first()


def test_quality_of_a_clean_and_a_dirty_table(spark):
    dirty = spark.createDataFrame(
        [(i % 5, None if i < 8 else "x", "same", 1000.0 if i == 9 else float(i % 3)) for i in range(10)],
        "row_id int, mostly_null string, constant string, v double",
    )
    row = quality.quality_scores(dirty).first()
    # 80 % complete, one extreme outlier: mean of 80, 100, 85, 100, 100, less two for each of three issues.
    assert row["issues"] == 3 and row["overall_score"] == 87.0
    kinds = {r["type"] for r in quality.issues(dirty).collect()}
    assert {"high_missing_values", "constant_column"} <= kinds


def test_cleaning_strategies(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (1, 1.0, "a"), (2, None, "b"), (3, 4.0, None), (4, None, "b")], "id int, x double, k string"
    )
    assert cleaning.clean(df).count() == 4
    filled = {r["id"]: (r["x"], r["k"]) for r in cleaning.clean(df, missing_strategy="mean_median").collect()}
    assert filled[2] == (2.5, "b") and filled[3] == (4.0, "b")
    forward = cleaning.clean(df, missing_strategy="forward_fill", order=["id"])
    assert {r["id"]: r["x"] for r in forward.collect()} == {1: 1.0, 2: 1.0, 3: 4.0, 4: 4.0}
    with pytest.raises(ValueError):
        cleaning.handle_missing(df, "guess")


def test_scaling_of_constant_columns(spark):
    df = frame(spark, {"x": [3.0] * 5, "y": [1.0, 2, 3, 4, 100]})
    assert derive.standard_scale(df, ["x"]).agg(F.max("x")).first()[0] == 0.0
    scaled = derive.robust_scale(df, ["x", "y"]).collect()
    assert [r["x"] for r in scaled] == [0.0] * 5
    assert sorted(r["y"] for r in scaled)[2] == 0.0


def test_type_counts_include_booleans(spark):
    df = spark.range(3).select("id", (F.col("id") > 1).alias("flag"), F.lit("x").alias("a"), F.lit("y").alias("b"))
    got = {r["type_group"]: r["columns"] for r in describe.type_counts(df).collect()}
    assert got == {"numeric": 1, "boolean": 1, "categorical": 2}


def test_profile_parts_of_a_mixed_table(spark, folder):
    parts = profile.profile_table(table(spark, folder, "events"))
    assert {"schema", "columns", "numeric", "categorical", "datetime_ts"} <= set(parts)
    assert parts["schema"].count() == 6


def test_samples_of_repeated_rows_have_the_wanted_size(spark):
    """Copies of a row are drawn one by one, so 40 distinct rows can fill a sample."""
    from tidemark.operators import sampling

    df = spark.range(400_000).select((F.col("id") % 40).cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("y"))
    for size in (25_600, 1_500):
        drawn = sampling.bounded_sample(df, df.columns, size, 400_000, 42, unique=False)
        counts = [r["count"] for r in drawn.groupBy("x", "y").count().collect()]
        assert sum(counts) == size and len(counts) == 40
        assert max(counts) < 2 * size / 40
    spoilt = df.union(spark.createDataFrame([(900.0, 900.0), (-900.0, 5.0)], df.schema))
    found = anomalies.multivariate_anomalies(spoilt, ["x", "y"], 0.000004, "elliptic_envelope")
    assert {r["x"] for r in found.orderBy("score").limit(2).collect()} == {900.0, -900.0}
    flagged = anomalies.multivariate_anomalies(df, ["x", "y"], 0.05).where("is_anomaly").count()
    assert 0 < flagged <= 20_000


def test_mean_filling_leaves_complete_columns_alone(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1, None), (big + 1, None, "a"), (big + 2, 4, "a")], "id long, x int, t string")
    got = cleaning.fill_means_and_modes(df)
    assert dict(got.dtypes) == {"id": "bigint", "x": "double", "t": "string"}
    assert sorted(map(tuple, got.collect())) == [(big, 1.0, "a"), (big + 1, 2.5, "a"), (big + 2, 4.0, "a")]


@pytest.mark.parametrize("size", [4000, 6000])
def test_skewed_groups_are_never_taken_for_normal(spark, size):
    """The test must not change only because groups outgrow the range of Shapiro-Wilk."""
    rng = np.random.default_rng(size)
    grp = np.repeat(["a", "b"], size)
    skewed, normal = rng.lognormal(size=2 * size), rng.normal(size=2 * size)
    df = frame(spark, {"g": grp, "skewed": skewed, "normal": normal})
    got = {r["column"]: r for r in hypothesis.compare_groups(df, "g", ["skewed", "normal"]).collect()}
    assert got["skewed"]["test"] == "kruskal_wallis" and not got["skewed"]["assumptions_met"]
    assert got["normal"]["test"] == "anova" and got["normal"]["assumptions_met"]
    tested = {(r["column"], r["test"]) for r in hypothesis.shapiro(df, "g", ["skewed"]).collect()}
    assert tested == {("skewed", "shapiro_wilk" if size <= 5000 else "anderson_darling")}


def test_exact_u_has_no_limit_on_the_larger_sample():
    small = hypothesis._exact_u_tail(20.0, 3, 9)
    brute = [sum(1 for a in pick for b in range(12) if b not in pick and a > b) for pick in __import__("itertools").combinations(range(12), 3)]
    assert small == pytest.approx(sum(u >= 20 for u in brute) / len(brute))
    assert 0.4 < hypothesis._exact_u_tail(100_000.0, 2, 100_000) < 0.6


def test_description_in_one_call_and_profile_with_normality(spark):
    df = frame(spark, {"x": [float(i % 7) for i in range(40)], "t": ["a", "b"] * 20})
    parts = describe.describe_dataset(df)
    assert {"overview", "types", "missing", "missing_summary", "numeric", "categorical"} == set(parts)
    assert all(p.count() > 0 for p in parts.values())
    whole = profile.profile_table(df)
    assert whole["normality"].first()["test"] == "shapiro_wilk" and whole["types"].count() == 2


def test_pairs_follow_a_significant_comparison(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, {
        "g": np.repeat(["a", "b", "c"], 60), "far": np.concatenate([rng.normal(m, 1, 60) for m in (0, 0, 9)]),
        "same": rng.normal(0, 1, 180), "skewed": np.concatenate([rng.lognormal(m, 1, 60) for m in (0, 0, 3)]),
    })
    compared = hypothesis.compare_groups(df, "g", ["far", "same", "skewed"])
    pairs = hypothesis.follow_up(df, "g", compared).collect()
    assert {(r["column"], r["test"]) for r in pairs} == {("far", "t_test"), ("skewed", "mann_whitney")}
    small = {(r["column"], r["group1"], r["group2"]) for r in pairs if r["p_value"] < 0.001}
    assert small == {(c, a, "c") for c in ("far", "skewed") for a in ("a", "b")}


def test_series_and_groups_too_small_are_named_with_a_reason(spark):
    rows = [(u, f"2024-01-{d + 1:02d}", float(d)) for u, n in (("a", 9), ("b", 12)) for d in range(n)]
    df = spark.createDataFrame(rows, "u string, d string, v double").withColumn("d", F.to_timestamp("d"))
    short = anomalies.short_series(df, "d", "v", [], ["u"]).collect()
    assert [(r["u"], r["n"]) for r in short] == [("a", 9)] and "at least 10" in short[0]["reason"]
    few = bootstrap.undrawn_groups(df, "u", ["v"]).collect()
    assert [(r["grp"], r["n"], r["median"]) for r in few] == [("a", 9, 4.0)]


def test_one_short_series_does_not_cost_the_others_their_lags(spark):
    rng = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=200)
    long = pd.DataFrame({"u": "long", "d": days, "v": rng.normal(size=200)})
    mid = pd.DataFrame({"u": "mid", "d": days[:25], "v": rng.normal(size=25)})
    found = anomalies.series_forest_anomalies(spark.createDataFrame(pd.concat([long, mid])), "d", "v", [], ["u"])
    counts = {r["u"]: r["count"] for r in found.groupBy("u").count().collect()}
    assert counts["long"] == 170 and counts["mid"] == 18


def test_statistics_are_joined_by_their_bytes(spark, monkeypatch):
    from tidemark.plans import joining

    rows = spark.range(50).select((F.col("id") % 5).alias("k"), "id")
    stats = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("wide"))
    stored = joining.freeze(stats)
    assert 5000 < joining.stored_bytes(stored) < 6000
    one = sorted(map(tuple, joining.attach(rows, stats, ["k"]).collect()))
    monkeypatch.setattr(joining, "BROADCAST_BYTES", 100)
    assert sorted(map(tuple, joining.attach(rows, stats, ["k"]).collect())) == one and len(one) == 50
