"""Replicate weights against theory and a plain loop; the running minimum against a list."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hypothesis, replicates
from tidemark.plans.ordered import minimum_from_here


def test_weights_are_poisson_and_independent_of_partitions(spark):
    rows = spark.range(20_000).withColumn("row", replicates.row_seed(["id"], 1))
    drawn = rows.withColumn("draw", F.explode(F.array(*[F.lit(k) for k in range(10)])))
    drawn = drawn.withColumn("w", replicates.weight(F.col("row"), F.col("draw").cast("long")))
    shares = {r.w: r["count"] / 200_000 for r in drawn.groupBy("w").count().collect()}
    for k in range(5):
        assert abs(shares[k] - math.exp(-1) / math.factorial(k)) < 0.006
    wide = np.array([r.ws for r in drawn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("draw", "w")))["w"].alias("ws")).collect()])
    correlations = np.corrcoef(wide.T) - np.eye(10)
    assert np.abs(correlations).max() < 0.04
    # totals of replicates spread like those of independent weights
    totals = wide.sum(axis=0)
    assert abs(totals.mean() - 20_000) < 300 and totals.std() < 400


def test_table_of_weights_is_that_of_the_columns(spark):
    rows, draws = [0, 1, 77, (1 << 28) - 1, *random.Random(5).sample(range(1 << 28), 300)], 40
    df = spark.createDataFrame([(r,) for r in rows], "row long").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    want = {(r["row"], r["draw"]): r["w"] for r in df.withColumn("w", replicates.weight(F.col("row"), F.col("draw").cast("long"))).collect()}
    got = replicates.weight_table(np.array(rows), np.arange(draws))
    assert all(got[k, i] == want[r, k] for i, r in enumerate(rows) for k in range(draws))


def test_no_row_for_each_row_and_replicate(spark):
    df = spark.range(1000).withColumn("y", F.col("id") * 1.5)
    found = replicates.bootstrap_draws(df, "y", ["id"], draws=50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan
    assert found.count() == 50


def test_sums_of_groups_follow_the_plain_definition(spark):
    rows = [(i, float(i % 17) if i % 5 else None, f"g{i % 7 if i % 11 else 'x'}") for i in range(700)]
    df = spark.createDataFrame(rows, "i int, y double, g string").repartition(3)
    halves = replicates.Statistic({"half": lambda y, x: F.when(y > 0, y / 2)}, lambda s: s["half"] / s["w"])
    got = {(r.grp, r.draw): r.value for r in replicates.bootstrap_draws(df, "y", ["i"], halves, "g", draws=9).collect()}
    seeds = {r.i: r.s for r in df.select("i", replicates.row_seed(["i"], 42).alias("s")).collect()}
    known = [r for r in rows if r[1] is not None]
    for g in {r[2] for r in known}:
        own = [r for r in known if r[2] == g]
        centre = sum(r[1] for r in own) / len(own)
        w = replicates.weight_table(np.array([seeds[r[0]] for r in own]), np.arange(9)).astype(float)
        for k in range(9):
            above = [(w[k, j], r[1] - centre) for j, r in enumerate(own) if w[k, j] > 0 and r[1] > centre]
            want = sum(a * v / 2 for a, v in above) / w[k].sum() if above else None
            assert got.get((g, k)) == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("statistic", ["MEAN", "DEVIATION", "SLOPE"])
def test_errors_agree_with_theory(spark, statistic):
    rng = np.random.default_rng(4)
    x, noise = rng.uniform(0, 10, 3000), rng.normal(0, 2, 3000)
    y = 1e6 + 3.0 * x + noise if statistic == "SLOPE" else 1e6 + noise
    df = spark.createDataFrame([(i, float(a), float(b), "g") for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double, g string")
    place = "x" if statistic == "SLOPE" else None
    got = replicates.bootstrap(df, "y", ["i"], getattr(replicates, statistic), "g", place, draws=400).first()
    want, error = {
        "MEAN": (y.mean(), y.std(ddof=1) / math.sqrt(3000)),
        "DEVIATION": (y.std(ddof=1), y.std(ddof=1) / math.sqrt(6000)),
        "SLOPE": (np.polyfit(x, y, 1)[0], 2 / (x.std() * math.sqrt(3000))),
    }[statistic]
    assert abs(got["mean"] - want) < error
    assert abs(got["error"] / error - 1) < 0.2
    assert got["ci_lower"] < want < got["ci_upper"] and got["replicates"] == 400
    assert replicates.bootstrap(df.repartition(7), "y", ["i"], getattr(replicates, statistic), "g", place, draws=400).first()["ci_lower"] == pytest.approx(got["ci_lower"], rel=1e-9)


def test_odd_rows(spark):
    schema = "i int, y double, g string"
    assert replicates.bootstrap(spark.createDataFrame([], schema), "y", ["i"], group="g").collect() == []
    rows = [(1, 2.0, "a"), (2, None, "a"), (3, float("nan"), "a"), (4, 1.0, None), (None, 2.0, "a")]
    got = replicates.bootstrap(spark.createDataFrame(rows, schema), "y", ["i"], group="g").collect()
    assert [(r.grp, r.ci_lower, r.ci_upper) for r in got] == [("a", 2.0, 2.0)] and got[0].replicates < 200
    with pytest.raises(ValueError):
        replicates.bootstrap(spark.createDataFrame(rows, schema), "y", ["i"], replicates.SLOPE)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_minimum_from_here(spark, keys):
    rng = random.Random(3)
    rows = [(i % 3, i, rng.choice([None, rng.random()])) for i in range(500)]
    got = minimum_from_here(spark.createDataFrame(rows, "k int, o int, v double"), keys, ["o"], "v", "m").collect()
    for r in got:
        ahead = [v for k, o, v in rows if o >= r.o and v is not None and (not keys or k == r.k)]
        assert r.m == (min(ahead) if ahead else None)
    assert len(got) == 500


def test_adjusted_values_need_no_single_task(spark):
    rng = random.Random(1)
    ps = [rng.random() ** 3 for _ in range(400)] + [0.5, 0.5, None]
    adjusted = hypothesis.benjamini_hochberg(spark.createDataFrame([(p,) for p in ps], "p_value double"))
    filled = sorted((1.0 if p is None else p) for p in ps)
    m, low, want = len(filled), 1.0, []
    for i in range(m - 1, -1, -1):
        low = min(low, filled[i] * m / (i + 1))
        want.append(low)
    got = sorted((r.p_value_corrected for r in adjusted.collect()), reverse=True)
    assert got == pytest.approx(want)
    assert "SinglePartition" not in adjusted._jdf.queryExecution().executedPlan().toString()
