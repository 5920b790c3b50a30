"""Decontamination: planted copies are found, clean documents stay, alignment equals brute force."""

import random

import numpy as np

from tidemark.llm import decontaminate as dc

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(900)]


def plain(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def brute_align(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a == b else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 40))
        assert dc.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def corpus():
    items = [plain(RNG.randint(14, 60)) for _ in range(25)]
    docs, planted = [], set()
    for i in range(150):
        text, kind = plain(RNG.choice([5, 100, 400])), i % 5
        item = i % len(items)
        if kind in (1, 2, 3):
            copy = list(items[item])
            if kind == 2:
                for p in range(3, len(copy), 6):
                    copy[p] = RNG.choice(WORDS)
            if kind == 3:
                copy = [w for k, w in enumerate(copy) if k % 8 != 5]
            at = RNG.randint(0, len(text))
            text[at:at] = copy
            planted.add((i, item))
        joined = " ".join(text)
        docs.append((i, joined.upper().replace(" ", ", ", 7) if kind == 3 else joined, "clash"))
    return docs, [(i, " ".join(w).capitalize() + ".") for i, w in enumerate(items)], planted


def brute(docs, items):
    found = set()
    for d, text, *_ in docs:
        for i, item in items:
            if len(dc.words_of(item)) >= 3:
                vocab = {w: n for n, w in enumerate(dict.fromkeys(dc.words_of(item)), 1)}
                a, b = [vocab[w] for w in dc.words_of(item)], [vocab.get(w, 0) for w in dc.words_of(text)]
                if b and dc.align(np.array(a), np.array(b))[0] >= dc.LEAST_SCORE * dc.MATCH * len(a):
                    found.add((d, i))
    return found


def test_planted_items_against_brute_force(spark):
    docs, items, planted = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    rows = dc.contaminated(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == brute(docs, items) and planted <= got
    for r in rows:
        words = dc.words_of(docs[r["doc_id"]][1])[r["first_word"] : r["last_word"] + 1]
        assert set(words) & set(dc.words_of(items[r["item_id"]][1])) and 0.5 <= r["score"] <= 1
    kept = dc.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in got}


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items, _ = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(df, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 10)
    assert sorted(map(tuple, dc.contaminated(df, bench).collect())) == whole


def test_odd_rows(spark):
    item = " ".join(plain(20))
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (None, item), (None, "clean text of five"), (4, "x " * 50_000)], "doc_id long, text string")
    assert sorted(((r[0], r[1], r[2]) for r in dc.contaminated(docs, bench).collect()), key=str) == [(3, 1, 1.0), (None, 1, 1.0)]
    assert sorted(str(r[0]) for r in dc.drop_contaminated(docs, bench).collect()) == ["1", "2", "4", "None"]
    assert dc.contaminated(docs.where("false"), bench).collect() == []
    assert dc.contaminated(docs, bench.where("false")).collect() == []


def test_short_items_are_matched_word_for_word(spark):
    items = [(1, "What is the capital of France?"), (2, "two words"), (3, "Single"), (4, "\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f"),
             (5, "\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07\u0e02\u0e2d\u0e07\u0e44\u0e17\u0e22"), (6, "a b c d e f g h i j")]
    docs = [
        (1, "so: what is the capital, of France then"), (2, "the capital of France is large"), (3, "one two words"),
        (4, "two other words"), (5, "a single one"), (6, "\u8bf7\u95ee\u4e2d\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\u3002\u8c22\u8c22"),
        (7, "\u4e2d\u56fd\u7684\u5927\u5b66"), (8, "\u0e01\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07\u0e02\u0e2d\u0e07\u0e44\u0e17\u0e22\u0e01"),
        (9, "x a b c d e f y"), (10, "x a b c d e f g y"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (3, 2), (5, 3), (6, 4), (8, 5), (10, 6)}
    assert all(r["score"] == (0.7 if r["item_id"] == 6 else 1.0) for r in rows)
    places = {r["item_id"]: (r["first_word"], r["last_word"]) for r in rows}
    assert places[1] == (1, 6) and places[2] == (1, 2) and places[3] == (1, 1) and places[4] == (2, 9)
    short = bench.where("item_id in (2, 3)")
    assert {r["doc_id"] for r in dc.drop_contaminated(df, short).collect()} == set(range(1, 11)) - {3, 5}
