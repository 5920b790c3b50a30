"""Pairwise rank sums against counting all pairs of values."""

import random

import pytest

from tidemark.operators import hypothesis, pairwise_ranks


def brute(values):
    """{(i, j): (u, shared ties)} by comparing each value of i with each of j."""
    out = {}
    for i in values:
        for j in values:
            if i < j:
                a, b = values[i], values[j]
                u = sum((x > y) + (x == y) / 2 for x in a for y in b)
                shared = set(a) & set(b)
                ties = sum(3 * (a.count(v) ** 2 * b.count(v) + a.count(v) * b.count(v) ** 2) for v in shared)
                out[i, j] = (u, ties)
    return out


@pytest.mark.parametrize("chunk,cells,step", [(256, 200_000, 2_000), (3, 40, 7), (1, 9, 1)])
def test_pairs(spark, monkeypatch, chunk, cells, step):
    monkeypatch.setattr(pairwise_ranks, "STEP_VALUES", step)
    rng = random.Random(chunk)
    values = {g: [rng.randrange(4 + 30 * (g % 3)) / 2 for _ in range(rng.choice([1, 5, 60]))] for g in range(8)}
    rows = [(g, float(v), values[g].count(v)) for g in values for v in set(values[g])]
    df = spark.createDataFrame(rows, "gid long, value double, c long")
    got = {(r.i, r.j): (r.u, r.shared_ties) for r in pairwise_ranks.pair_sums(df, 8, chunk, cells).collect()}
    assert got == brute(values)


def test_many_groups_without_a_list(spark):
    df = spark.range(6_000).selectExpr("concat('g', id % 600) g", "cast(hash(id) % 50 as double) v")
    got = hypothesis.pairwise_mann_whitney(df, "g", "v")
    assert got.count() == 600 * 599 // 2
    row = got.where("group1 = 'g17' and group2 = 'g401'").first()
    sides = {r.g: r.vs for r in df.groupBy("g").agg({"v": "collect_list"}).toDF("g", "vs").where("g in ('g17', 'g401')").collect()}
    want = sum((x > y) + (x == y) / 2 for x in sides["g17"] for y in sides["g401"])
    assert row.statistic == want and (row.n1, row.n2) == (10, 10)
