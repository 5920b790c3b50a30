"""Cells that sure links join already are not compared point by point; the clusters are those of a plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dbscan


def _plain(points: np.ndarray, eps: float, needed: int) -> list[int]:
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= needed
    label, at = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        reach = [i]
        while reach:
            j = reach.pop()
            if label[j] < 0:
                label[j] = at
                reach.extend(k for k in np.flatnonzero(near[j] & core) if label[k] < 0)
        at += 1
    return [(set(label[near[i] & core]) if not core[i] else {label[i]}) for i in range(len(points))]


@pytest.mark.parametrize("d", [2, 4])
def test_clusters_of_a_plain_search(spark, monkeypatch, d):
    # pairs of cells are halved several times before they are compared directly
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", 6)
    rng = random.Random(d)
    centres = [[rng.uniform(0, 4) for _ in range(d)] for _ in range(9)]
    points = [[rng.gauss(v, 0.25) for v in rng.choice(centres)] for _ in range(350)] + [[rng.uniform(0, 4) for _ in range(d)] for _ in range(60)]
    # two strips whose points come close to each other in one place only
    points += [[i * 0.02, 6.0, *[0.0] * (d - 2)] for i in range(40)] + [[i * 0.02, 6.55 if i < 39 else 6.48, *[0.0] * (d - 2)] for i in range(40)]
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], f"id int, {', '.join(f'{n} double' for n in names)}")
    got = {r.id: r.cluster for r in dbscan.label_dense_regions(df, names, 0.5, 5).collect()}
    want = _plain(np.array(points), 0.5, 5)
    ids = {}
    for i, allowed in enumerate(want):
        if len(allowed) == 1:
            assert ids.setdefault(next(iter(allowed)), got[i]) == got[i]
        assert (got[i] == -1) == (not allowed)
    assert len(set(ids.values())) == len(ids) > 2


def test_crowded_cells_in_one_cluster_are_not_halved(spark, monkeypatch):
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", 100)
    levels, grid = [], dbscan._grid

    def spy(names, side):
        levels.append(side)
        return grid(names, side)

    monkeypatch.setattr(dbscan, "_grid", spy)
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(6000)], "a double, b double")
    assert [r.cluster for r in dbscan.label_dense_regions(df, ["a", "b"], 0.5, 5).select(F.col("cluster")).distinct().collect()] == [0]
    # one grid for the cells, one for the first comparison
    assert len(levels) == 2
