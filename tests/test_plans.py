"""Ordered computations and quantiles against plain pandas."""

import pathlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.catalog.registry import table
from tidemark.operators import components
from tidemark.operators.components import connected_components
from tidemark.plans import ordered, quantiles, storage
from tidemark.plans.joining import attach, null_safe_join


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")


def as_pandas(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def test_position_is_the_sorted_row_number(spark, folder):
    df = events(spark, folder)
    got = as_pandas(ordered.with_position(df, ["ts", "event_id"], ["event_type"]), "event_id")
    want = as_pandas(df, ["ts", "event_id"])
    want["pos"] = want.groupby("event_type").cumcount()
    want = want.sort_values("event_id").reset_index(drop=True)
    assert (got["pos"] == want["pos"]).all()
    assert (got["n"] == want.groupby("event_type")["event_id"].transform("size")).all()


def test_position_does_not_depend_on_partitioning(spark, folder):
    df = events(spark, folder)
    first = as_pandas(ordered.with_position(df.repartition(1), ["ts", "event_id"]), "event_id")
    second = as_pandas(ordered.with_position(df.repartition(13), ["ts", "event_id"]), "event_id")
    assert (first["pos"] == second["pos"]).all()


def test_null_keys_form_their_own_series(spark, folder):
    df = events(spark, folder).withColumn("k", F.nullif("event_type", F.lit("click")))
    placed = ordered.with_position(df, ["ts", "event_id"], ["k"])
    assert placed.count() == df.count()
    nulls = placed.where("k is null")
    assert nulls.agg(F.max("pos")).first()[0] == df.where("event_type = 'click'").count() - 1


@pytest.mark.parametrize("block_rows", [7, 40, 100_000])
def test_halo_windows_equal_one_long_window(spark, folder, block_rows):
    df = events(spark, folder)
    placed = ordered.with_position(df, ["ts", "event_id"])

    def outputs(block):
        return {
            "late": F.lag("value", 5).over(block),
            "mean": F.avg("value").over(block.rowsBetween(-3, 2)),
        }

    got = as_pandas(ordered.halo_window(placed, [], 5, 2, outputs, block_rows=block_rows), "pos")
    assert len(got) == df.count()
    assert np.allclose(got["late"], got["value"].shift(5), equal_nan=True)
    want = [got["value"][max(0, i - 3) : i + 3].mean() for i in range(len(got))]
    assert np.allclose(got["mean"], want)


@pytest.mark.parametrize("centred", [True, False])
def test_rolling_equals_pandas(spark, folder, centred):
    placed = ordered.with_position(events(spark, folder), ["ts", "event_id"])
    for window in (7, 30, F.lit(30)):
        got = as_pandas(ordered.rolling(placed, [], "value", window, centred), "pos")
        size = window if isinstance(window, int) else 30
        rolled = got["value"].rolling(size, center=centred)
        assert np.allclose(got["rolling_mean"], rolled.mean(), equal_nan=True)
        assert np.allclose(got["rolling_std"], rolled.std(), equal_nan=True)


def test_forward_fill_reaches_across_blocks(spark, folder):
    df = events(spark, folder).withColumn("sparse", F.when(F.col("event_id") % 97 == 3, F.col("value")))
    got = as_pandas(ordered.forward_fill(df, ["sparse"], ["ts", "event_id"]), ["ts", "event_id"])
    want = as_pandas(df, ["ts", "event_id"])["sparse"].ffill()
    assert np.allclose(got["sparse"].astype(float), want.astype(float), equal_nan=True)


@pytest.mark.parametrize("by", [[], ["l_returnflag"]])
def test_distributed_quantiles_equal_percentile(spark, folder, by):
    line = table(spark, folder, "lineitem")
    probs = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    columns = ["l_quantity", "l_extendedprice"]
    near = as_pandas(quantiles.quantiles(line, columns, probs, by), [*by, "column"])
    far = as_pandas(quantiles.quantiles(line, columns, probs, by, small_values=0), [*by, "column"])
    assert np.allclose(near[list(probs)], far[list(probs)])
    if not by:
        want = line.select("l_quantity").toPandas()["l_quantity"].quantile(list(probs.values()))
        assert np.allclose(far[far["column"] == "l_quantity"][list(probs)].to_numpy()[0], want)


def test_a_hot_value_holding_a_third_of_rows(spark, folder):
    line = table(spark, folder, "lineitem").withColumn(
        "v", F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_extendedprice"))
    )
    far = quantiles.quantiles(line, ["v"], {"q": 0.4}, small_values=0).first()["q"]
    assert far == pytest.approx(line.select("v").toPandas()["v"].quantile(0.4))


def test_signed_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (0.0,), (1.0,)], "x double")
    counts = quantiles.value_counts(quantiles.melt(df, ["x"]), ["column"])
    assert sorted(r["c"] for r in counts.collect()) == [1, 3]


def test_joins_match_null_with_null(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    for joined in (null_safe_join(left, right, ["k"]), attach(left, right, ["k"])):
        assert sorted((r["x"], r["y"]) for r in joined.collect()) == [(1, 10), (2, 20)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(201), *range(1000, 1050), 5000]], "node long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(201)} == {0}
    assert {got[i] for i in range(1000, 1050)} == {1000}
    assert got[5000] == 5000


def test_components_that_are_stars_are_stored_twice(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(components, "freeze", lambda df: stored.append(df) or storage.freeze(df))
    edges = spark.range(1, 40).selectExpr("id as a", "id % 3 as b").where("a > 2")
    nodes = spark.range(40).withColumnRenamed("id", "node")
    got = {r["node"]: r["component"] for r in components.connected_components(nodes, edges).collect()}
    assert got == {i: i % 3 for i in range(40)}
    assert len(stored) == 2


def test_a_round_of_components_shuffles_its_links_once(spark):
    edges = storage.freeze(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
    stars = components._star(components._star(edges, large=True), large=False).distinct()
    stars.collect()
    final = stars._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = [line for line in final.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert len(shuffles) == 3, final


def test_freezing_leaves_no_shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    folders = [pathlib.Path(str(f)) for f in jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in folders for f in d.rglob("shuffle_*")}
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = files()
    frozen = storage.freeze(df)
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert frozen.count() == df.count() == 10
