"""Kendall's second side is the column with fewer values; its result does not depend on that."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import kendall


def test_second_side_has_fewer_values(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(5), rng.random(), rng.randrange(3)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a int, b double, c int")
    seen, inversions = [], kendall._inversions

    def spy(cells, block_rows):
        seen.extend(cells.groupBy("pair").agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).collect())
        return inversions(cells, block_rows)

    monkeypatch.setattr(kendall, "_inversions", spy)
    got = {(r.column1, r.column2): r.correlation for r in kendall.kendall(df, ["a", "b", "c"], block_rows=300).collect()}
    assert len(seen) == 3 and all(r.x >= r.y for r in seen)
    columns = {n: np.array([r[i] for r in rows]) for i, n in enumerate("abc")}
    signs = {n: np.sign(v[:, None] - v[None, :]) for n, v in columns.items()}
    for (p, q), tau in got.items():
        s = (signs[p] * signs[q]).sum()
        assert tau == pytest.approx(s / math.sqrt((signs[p] ** 2).sum() * (signs[q] ** 2).sum()))
