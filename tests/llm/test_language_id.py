"""Language identification: held-out accuracy, evidence against the text, rejection, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li


@pytest.fixture(scope="module")
def found(spark):
    """Given documents; every tenth declares a wrong language or none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = F.when(F.col("doc_id") % 20 == 0, F.when(F.col("lang") == "en", "fr").otherwise("en")).when(
        F.col("doc_id") % 20 == 10, F.lit(None)
    )
    given = docs.withColumn("said", F.when(F.col("doc_id") % 10 == 0, wrong).otherwise(F.col("lang")))
    return li.identify(given, "text", F.col("said"), F.col("source")).collect()


def test_documents_with_a_wrong_declaration_are_recognised(found):
    assert len(found) == 1000
    held_out = [r for r in found if r["doc_id"] % 10 == 0 and len(r["text"]) > 300]
    assert sum(r["__lang"] == r["lang"] for r in held_out) / len(held_out) > 0.95
    assert sum(r["__lang"] == r["lang"] for r in found) / len(found) > 0.97


def test_documents_of_words_are_kept(found):
    assert all(r["__kept"] for r in found if sum(c.isalpha() for c in r["text"]) > 0.5 * len(r["text"]))


def test_noise_and_empty_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang", "source")
    rng = random.Random(1)
    noise = ["".join(chr(rng.randint(33, 126)) for _ in range(600)) for _ in range(3)] + [None, "", " \n", "1234 ---"]
    odd = spark.createDataFrame([(t, None, None) for t in noise] + [("The " * 50_000, "xx", "new")], docs.schema)
    got = li.identify(docs.unionByName(odd).withColumn("__x", F.lit(1)), "text", F.col("lang"), F.col("source"))
    rows = [r for r in got.collect() if r["source"] in (None, "new")]
    assert got.columns[:4] == ["text", "lang", "source", "__x"] and len(rows) == 8
    assert [r["__kept"] for r in sorted(rows, key=lambda r: len(r["text"] or ""))] == [False] * 7 + [True]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert li.keep_identified(docs).collect() == [] and li.keep_identified(docs).columns == docs.columns


def test_host_shares_are_smoothed_towards_the_suffix(spark):
    rows = [("t", "en", "com", "a.com")] * 30 + [("t", "de", "de", "b.de")] * 30 + [("t", "en", "de", "c.de")]
    df = spark.createDataFrame(rows, "text string, declared string, suffix string, host string")
    shares = {r["__host"]: r["__share"] for r in li.host_shares(df, ["en", "de"]).collect()}
    assert all(abs(sum(s) - 1) < 1e-9 for s in shares.values())
    assert shares["a.com"][0] > 0.8 and shares["b.de"][1] > 0.7 and shares["b.de"][1] > shares["c.de"][1] > 0.3


def test_evidence_from_markup_and_address(spark):
    df = spark.createDataFrame(
        [('<!DOCTYPE html><html class="x" lang="de-AT">', "https://a.Example.DE:80/x"), ("<p>", "no"), (None, None)], "h string, u string"
    )
    got = df.select(li.declared_in_markup(F.col("h")), li.address_suffix(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("de", "de"), (None, None), (None, None)]


def test_no_row_declares_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "source")
    odd = spark.createDataFrame([(t, "odd") for t in (None, "", "1234 ---", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059")], docs.schema)
    rows = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    found = li.identify(rows, "text", F.col("lang"), F.col("source"), F.lit("org")).collect()
    assert len(found) == 1004 and all(r["__lang"] is None and r["__confidence"] == 0.0 for r in found)
    assert all(r["__kept"] for r in found if sum(c.isalpha() for c in r["text"] or "") > 0.5 * len(r["text"] or "x"))
    assert not any(r["__kept"] for r in found if not any(map(str.isalpha, r["text"] or "")))
    assert li.keep_identified(rows.where("source = 'odd'")).count() == 1


def many_languages(n, each):
    """(text, tag, host, language) of n invented languages, each of words of its own letters."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        letters = [chr(0x0531 + 40 * i + j) for j in range(12)] if i < 2 else rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        for k in range(each):
            text = " ".join(rng.choice(words) for _ in range(80))
            rows.append((text, None if k == 0 else f"q{i:02}" + ("", "-US", "_GB")[k % 3], f"h{i % 7}", f"q{i:02}"))
    return rows


def test_every_declared_language_is_told_apart(spark, monkeypatch):
    rows = many_languages(80, 4)
    df = spark.createDataFrame(rows, "text string, tag string, host string, truth string")
    found = li.identify(df, "text", F.col("tag"), F.col("host"), F.col("host")).collect()
    assert len(found) == len(rows) and all(r["__kept"] and r["__lang"] == r["truth"] for r in found)
    monkeypatch.setattr(li, "LANGUAGES", 200)
    whole = li.identify(df, "text", F.col("tag"), F.col("host"), F.col("host")).collect()
    assert sorted((r["text"], r["__lang"], r["__kept"]) for r in whole) == sorted(
        (r["text"], r["__lang"], r["__kept"]) for r in found
    )


def test_every_value_of_the_evidence_counts(spark):
    rows = [("t", f"v{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, suffix string")
    held = li.models(df.selectExpr("text", "'en' declared"), ["en", "de"])
    keyed = df.withColumn("__own_suffix", F.col("suffix"))
    joined, size = li.join_evidence(keyed, df, held, ["en", "de"], "suffix")
    assert all(r["__own_suffix"]["__n"] == [1] for r in joined.collect()) and size.tolist() == [450.5, 150.5]


def test_primary_language(spark):
    tags = ["en-US", "EN_us", " de ", "zh-Hant-TW", "x-own", "", None]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    got = [r[0] for r in df.select(li.primary_language(F.col("t"))).collect()]
    assert got == ["en", "en", "de", "zh", "x-own", None, None]


def test_columns_with_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clash = docs.withColumns({c: F.lit(c) for c in ("value", "n", "row", "key", "best", "count", "language", "bucket")})
    kept = li.keep_identified(clash)
    assert kept.columns == clash.columns
    assert kept.select("doc_id").exceptAll(li.keep_identified(docs).select("doc_id")).isEmpty()
    assert kept.count() == li.keep_identified(docs).count()
