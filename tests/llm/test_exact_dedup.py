"""Exact dedup: the fuse filter, snapshots, colliding digests, odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fuse
from tidemark.llm.exact_dedup import drop_copies, exact_dedup

ROWS = [
    (1, "a", "x"), (2, "a", "y"), (3, "a", "x"), (4, None, "x"), (5, "", "x"), (6, "b", None),
    (7, "b" * 100_000, "x"), (8, "b" * 100_000, "x"), (9, "A", "x"), (9, "A", "x"), (None, "a", "x"), (None, "q", "x"),
]
SCHEMA = "doc_id long, text string, n string"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 50_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    built = fuse.build(keys)
    assert fuse.contains(keys, *built).all()
    assert fuse.contains(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64), *built).mean() < 0.02


def test_every_row_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, exact_dedup(df).collect()), key=str) == brute(ROWS)


def test_several_snapshots_give_the_same(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    parts = [F.coalesce(F.col("id") % 3 == k, F.lit(False)) for k in (0, 1)]
    assert sorted(map(tuple, exact_dedup(df, in_snapshot=parts).collect()), key=str) == brute(ROWS)


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = exact_dedup(df, digest=lambda t: F.length(t).cast("string")).drop("text_sha256").collect()
    assert sorted(map(tuple, weak), key=str) == sorted([r[:4] for r in brute(ROWS)], key=str)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    assert drop_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_text_stays_with_its_columns(spark):
    got = drop_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(
        [(3, "a"), (5, ""), (6, "b"), (8, "b" * 100_000), (9, "A"), (None, "q")], key=str
    )
