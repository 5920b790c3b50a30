"""Substring dedup against brute force, with hot minimisers and odd rows."""

import hashlib
import random

import numpy as np

from tidemark.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    ids = [sd.NO_ID if r[0] is None else r[0] for r in rows]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            first[s] = min(first.get(s, sd.NO_ID), i)
    out = []
    for r, i, w in zip(rows, ids, words):
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "x", "yy"])
    passages = [" ".join(word() for _ in range(rng.choice([12, 13, 14, 40]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))))
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts), "clash"))
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, " \n", ""), (None, rows[3][1], ""), (None, passages[5] + " end", ""),
             (5, rows[9][1], ""), (5, rows[5][1], ""), (5, rows[5][1], ""), (n + 3, "the " * 3000, ""), (n + 4, "the " * 90, "")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(map(tuple, sd.substring_dedup(df).drop("kept").collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = texts()
    assert run(spark, rows) == brute(rows)
    unique = [r for r in {r[0]: r for r in rows}.values() if r[0] is not None]
    assert run(spark, unique) == brute(unique)


def test_hot_minimisers_take_the_other_way_to_the_same_result(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{base} tail{i % 7} {i}", "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id as doc", "0L as mark", "text")
    assert sd.hot_minimisers(sd.shared_minimisers(df), 4)
    assert run(spark, rows) == brute(rows)


def test_too_many_shared_minimisers_to_send(spark, monkeypatch):
    rows = texts(5, 60)
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == brute(rows)


def test_all_hot_equals_none_hot(spark, monkeypatch):
    rows = texts(3, 60)
    monkeypatch.setattr(sd, "hot_minimisers", lambda *_: [])
    assert run(spark, rows) == brute(rows)


def test_block_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(sd, "BASE", np.uint64(0))
    packed = [b" ".join(b"%d" % (i + j) for j in range(14)) for i in (0, 0, 1, 50)]
    row, inside, n = sd.judge_block(np.array([4, 7, 9, 9]), packed)
    assert list(zip(row.tolist(), inside.tolist(), n.tolist())) == [(1, 0, 2), (2, 0, 1)]


def test_empty_table(spark):
    assert run(spark, [])  == []


def test_one_word_repeated_in_two_documents_is_hot(spark):
    rows = [(1, "the " * 30_000, ""), (2, "the " * 29_000 + "end", ""), (3, " ".join(f"w{i}" for i in range(500)), "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id as doc", "0L as mark", "text")
    shared = sd.shared_minimisers(df)
    assert shared.agg({"n": "max"}).first()[0] > 50_000
    assert len(sd.hot_minimisers(shared, 4)) == 1
    got = {r[0]: (r[1], r[2]) for r in run(spark, rows)}
    assert got == {1: (30_000, 0), 2: (29_001, 29_000), 3: (500, 0)}


def test_texts_of_common_words_bring_few_strings_to_travel(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(300)), "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id as doc", "0L as mark", "text")
    assert (sd.shared_minimisers(df).agg({"n": "sum"}).first()[0] or 0) < 300 * 288 / 100


def test_pieces_within_and_beyond_a_word(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 16)
    sd._POWERS.clear()
    texts_ = [b" a\tbb  c" + b"x" * 100 + b" a " + b"yy " * 40, b"", b"bb", b"\xc3\xa9 a"]
    raw, starts, ends, hashes, upto = sd.word_hashes(texts_)
    words = [w for t in texts_ for w in t.split()]
    assert [raw[a:b] for a, b in zip(starts, ends)] == words
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert upto.tolist() == np.cumsum([len(t.split()) for t in texts_]).tolist()
    sd._POWERS.clear()
