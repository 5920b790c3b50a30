"""One sort by value serves medians, normality and rank sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normality import log_normal_tails
from tidemark.operators import hypothesis


def _rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.choice([rng.randrange(40) / 4, rng.random() * 10])) for _ in range(n)]


def test_places_in_the_group_and_among_all(spark):
    rows = [*_rows(3000, 1), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("w", -F.col("v"))
    counts = hypothesis.grouped_counts(hypothesis.grouped_values(df, "g", ["v", "w"]))
    got = hypothesis.ranked_counts(counts).collect()
    kept = [(c, g, s * v) for c, s in (("v", 1), ("w", -1)) for g, v in rows if g is not None and v is not None]
    of, everyone = {}, {}
    for c, g, v in kept:
        of.setdefault((c, g), []).append(v)
        everyone.setdefault(c, []).append(v)
    of, everyone = ({k: np.sort(v) for k, v in d.items()} for d in (of, everyone))
    assert len(got) == len(set(kept))
    for r in got:
        own, others = of[r.column, r.grp], everyone[r.column]
        first, last = np.searchsorted(own, r.value), np.searchsorted(own, r.value, "right")
        assert (r.before, r.c, r.total) == (first, last - first, len(own))
        first, last = np.searchsorted(others, r.value), np.searchsorted(others, r.value, "right")
        assert (r.below, r.same, r.everyone) == (first, last - first, len(others))


def test_groups_are_compared_with_one_sort_of_the_values(spark, monkeypatch):
    df = spark.createDataFrame(_rows(20_000, 2), "g string, v double")
    sorts, ranged = [], type(df).repartitionByRange

    def counted(self, *args):
        sorts.append(args)
        return ranged(self, *args)

    monkeypatch.setattr(type(df), "repartitionByRange", counted)
    got = hypothesis.compare_groups(df, "g", ["v"]).first()
    assert len(sorts) == 1 and got["test"] == "kruskal_wallis"
    assert got["statistic"] == pytest.approx(hypothesis.kruskal(df, "g", ["v"]).first()["statistic"], rel=1e-9)


def test_logs_of_both_tails():
    z = np.array([-60.0, -36.0, -34.0, -9.0, -3.53, -0.5, 0.0, 0.5, 3.53, 9.0, 40.0, np.nan])
    low, high = log_normal_tails(z)
    for i, v in enumerate(z[:-1]):
        if v > -36:
            assert low[i] == pytest.approx(math.log1p(-math.erfc(v / math.sqrt(2)) / 2) if v > 0 else math.log(math.erfc(-v / math.sqrt(2)) / 2), rel=1e-14)
        mirrored = log_normal_tails(np.array([-v]))
        assert (mirrored[0][0], mirrored[1][0]) == (high[i], low[i])
    # two sides of where the continued fraction takes over, and the expansion of the far tail
    near, far = log_normal_tails(np.array([-35.35, -35.36]))[0]
    assert near - far == pytest.approx((35.36**2 - 35.35**2) / 2 + math.log(35.36 / 35.35), rel=1e-4)
    assert low[0] == pytest.approx(-1800 - math.log(60 * math.sqrt(2 * math.pi)) - 1 / 3600, abs=1e-6)
    assert math.isnan(low[-1])
