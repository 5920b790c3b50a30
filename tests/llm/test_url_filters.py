"""Url verdicts: parsing, rules, and exactness of the cascade over its universe."""

import random

from pyspark.sql import functions as F

from tidemark.llm import url_filters as uf

URLS = [
    (1, "http://A.Example.NET/en/5?x=/de/#y"), (2, "https://example.com/de/"), (3, "https://x.example.com/fr/"),
    (4, "ftp://notexample.com/de/"), (5, None), (6, "no scheme/en/"), (7, "http://free-bets.example.com"),
    (8, "http://a.net"), (9, "http://a.net?q=/"), (10, "http://free-bets.org/fr/x"), (11, "http://org/fr/"),
    (12, "x://y://z/en/"), (13, ""), (14, "http://www.spam-farm.com#/"), (14, "http://www.spam-farm.com#/"),
    (None, "http://É.NET/"), (15, "http://my-spam-farm.com/"),
]


def brute(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for action, h, p in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    if best:
        return host, path, *best
    return host, path, None, "block" if set(host.split(".")) & set(uf.BLOCKED_LABELS) else "allow"


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    got = sorted(map(tuple, uf.judge_urls(df).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u in URLS], key=str)
    assert uf.judge_urls(df.where("false")).collect() == []


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(5)
    keys = [(f"k{i}", rng.random() < 0.1) for i in range(20_000)]
    df = spark.createDataFrame(keys, "key string, listed boolean")
    cascade = uf.build_cascade(df)
    assert len(cascade.levels) > 1
    assert df.where(cascade.member(F.col("key")) != F.col("listed")).count() == 0
    for same in (True, False):
        all_same = df.withColumn("listed", F.lit(same))
        one = uf.build_cascade(all_same)
        assert all_same.where(one.member(F.col("key")) != F.lit(same)).count() == 0


def test_beyond_the_bound_a_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(URLS, "page_id long, url string")
    monkeypatch.setattr(uf, "FILTER_BYTES", 0)
    got = sorted(map(tuple, uf.judge_urls(df).collect()), key=str)
    assert got == sorted([(i, *brute(u)) for i, u in URLS], key=str)
