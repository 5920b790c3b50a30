"""Frequencies by head and digest against counting whole values."""

from collections import Counter

import pytest

from tidemark.operators import describe, frequencies, profile, quality

LONG = "x" * 80


def rows():
    # ties between long values that share their head, between a head and its longer form, nulls, an empty text
    values = [LONG + "b", LONG + "a", LONG + "a", LONG + "b", "x" * 64, "x" * 64, "", None, "é" * 64, "é" * 65, "z"]
    return [(v, LONG + "c" if i % 2 else None) for i, v in enumerate(values)]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(rows(), "value string, `count` string").repartition(4)


def expected(column):
    counted = Counter(r[column] for r in rows() if r[column] is not None)
    return sorted(counted.items(), key=lambda p: (-p[1], p[0].encode()))


def test_ranks_of_long_values_that_share_their_head(texts):
    got = profile.top_categories(texts, k=4).orderBy("column", "rank").collect()
    want = [("count", *p) for p in expected(1)[:4]] + [("value", *p) for p in expected(0)[:4]]
    assert [(r["column"], r["value"], r["count"]) for r in got] == want


def test_most_and_least_frequent(texts):
    got = {r["column"]: r for r in profile.categorical_profile(texts).collect()}["value"]
    rank = expected(0)
    assert (got["most_frequent"], got["most_frequent_count"]) == rank[0]
    assert (got["least_frequent"], got["least_frequent_count"]) == rank[-1]
    assert got["cardinality"] == len(rank)
    top = {r["column"]: r for r in describe.describe_categorical(texts).collect()}["value"]
    assert (top["top_value"], top["top_freq"], top["unique"], top["count"]) == (*rank[0], len(rank), 10)


def test_case_variants_of_long_texts(spark):
    df = spark.createDataFrame([("Y" * 70,), ("y" * 70,), ("y" * 71,), ("Ab",), ("ab",), (None,)], "t string")
    assert tuple(quality.case_variants(df).first()) == ("t", 3, 2)


def test_empty_table_and_all_null(spark):
    none = spark.createDataFrame([(None,)], "t string")
    assert profile.top_categories(none).count() == 0
    assert describe.describe_categorical(none).first()["count"] == 0
    assert quality.case_variants(none).count() == 0


def test_whole_texts_are_not_shuffled(spark):
    """Distinct values travel as heads and digests, far below the bytes of the texts."""
    df = spark.range(50).selectExpr("repeat(cast(id as string), 5000) as t")
    widths = frequencies.text_frequencies(df, ["t"]).selectExpr("length(head) + length(digest) as w").collect()
    assert len(widths) == 50 and max(r["w"] for r in widths) == frequencies.HEAD + 32
