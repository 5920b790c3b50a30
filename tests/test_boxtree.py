"""Trees of boxes, and what is found with them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering, dbscan
from tidemark.plans.boxtree import box_gap, leaf_boxes, near_leaves, with_leaf
from tests.test_operators import brute_dbscan


def points_frame(spark, points):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "i long, at array<double>")


def test_leaves_are_small_however_rows_share_a_slab(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(600, 5))
    points[:300, :3] = 0.25
    points[300:420, 3] = 0.5
    leafed = with_leaf(points_frame(spark, points), "at", 5, 20, fanout=4)
    got = leafed.collect()
    assert sorted(r["i"] for r in got) == list(range(600))
    sizes = leafed.groupBy("leaf").count().collect()
    assert max(r["count"] for r in sizes) <= 20


def test_equal_points_stay_together_and_empty_tables_have_no_leaves(spark):
    same = with_leaf(points_frame(spark, [[1.0, 2.0]] * 50 + [[3.0, 2.0]]), "at", 2, 10)
    assert sorted(r["count"] for r in same.groupBy("leaf").count().collect()) == [1, 50]
    empty = with_leaf(points_frame(spark, []), "at", 2, 10)
    assert near_leaves(leaf_boxes(empty, "at", 2), 2, lambda a, b: F.lit(True)).collect() == []


def test_no_near_pair_is_left_out(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 1, size=(300, 4))
    points[:150, 0] = 0.5
    leafed = with_leaf(points_frame(spark, points), "at", 4, 12, fanout=3)
    leaf = {r["i"]: r["leaf"] for r in leafed.collect()}
    eps = 0.2
    kept = {tuple(r) for r in near_leaves(leaf_boxes(leafed, "at", 4), 4, lambda a, b: box_gap(a, b, 4) <= eps * eps).collect()}
    near = ((points[:, None] - points[None]) ** 2).sum(-1) <= eps * eps
    for i, j in zip(*np.nonzero(near)):
        assert (leaf[i], leaf[j]) in kept
    assert len(kept) < len(set(leaf.values())) ** 2


@pytest.mark.parametrize("leaf_cells", [8, 64])
def test_dbscan_of_ten_features_with_half_of_the_rows_in_one_slab(spark, monkeypatch, leaf_cells):
    monkeypatch.setattr(dbscan, "LEAF_CELLS", leaf_cells)
    rng = np.random.default_rng(3)
    d, eps, needed = 10, 1.2, 5
    points = np.vstack([rng.normal(c, 0.3, (60, d)) for c in (0.0, 2.0, 4.0)] + [rng.uniform(-3, 7, (40, d))])
    points[:110, :3] = 0.05
    names = [f"f{i}" for i in range(d)]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    got = np.array([r["cluster"] for r in dbscan.label_dense_regions(df, names, eps, needed).orderBy("i").collect()])
    core, label, allowed = brute_dbscan(points, eps, needed)
    assert core.any() and not core.all()
    name = {}
    for i in np.flatnonzero(core):
        assert name.setdefault(label[i], got[i]) == got[i]
    assert len(set(name.values())) == len(name) > 1
    for i in np.flatnonzero(~core):
        wanted = {name[k] for k in allowed[i]}
        assert got[i] in wanted if wanted else got[i] == -1


@pytest.mark.parametrize("leaf_centres", [6, 256])
def test_worst_ratios_equal_all_pairs(spark, monkeypatch, leaf_centres):
    monkeypatch.setattr(clustering, "LEAF_CENTRES", leaf_centres)
    rng = np.random.default_rng(4)
    m, s = rng.uniform(0, 10, (90, 2)), rng.uniform(0.01, 0.3, 90)
    s[7] = 4.0
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(m, s))]
    df = spark.createDataFrame(rows, "cluster int, m0 double, m1 double, s double")
    got = {r["cluster"]: r["worst"] for r in clustering.worst_ratios(df, 2).collect()}
    gap = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    wanted = ((s[:, None] + s[None]) / gap).max(1)
    assert [got[i] for i in range(90)] == pytest.approx(list(wanted))


def test_centres_at_one_place_are_infinitely_bad(spark):
    df = spark.createDataFrame([(0, 1.0, 0.1), (1, 1.0, 0.2), (2, 3.0, 0.1)], "cluster int, m0 double, s double")
    got = {r["cluster"]: r["worst"] for r in clustering.worst_ratios(df, 1).collect()}
    assert got[0] == got[1] == float("inf") and got[2] == pytest.approx(0.3 / 2)
