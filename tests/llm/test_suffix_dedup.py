"""Suffix-array dedup: the order itself, queues on disk, and documents against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import induced_sort, suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_bytes string"


def brute_order(text, cap):
    raw = text.tobytes()
    order = sorted(range(len(raw)), key=lambda i: raw[i:])
    prefix = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        prefix.append(k)
    return order, prefix


@pytest.mark.parametrize("held", [induced_sort.HELD_BYTES, 0, 200])
def test_suffix_order_and_prefixes(monkeypatch, held):
    monkeypatch.setattr(induced_sort.Queue.__init__, "__defaults__", (held,))
    rng = random.Random(held)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 255])
        text = np.array([rng.randint(0, letters) for _ in range(rng.randint(1, 60))], dtype=np.uint8)
        text = np.tile(text, rng.choice([1, 1, 3]))
        order, prefix = induced_sort.suffix_order(text, 1000)
        assert (order.tolist(), prefix.tolist()) == brute_order(text, 1000)


def test_prefixes_are_right_up_to_the_cap():
    text = np.frombuffer((b"abcab" * 40 + b"x") * 4, dtype=np.uint8)
    order, prefix = induced_sort.suffix_order(text, 50)
    raw = text.tobytes()
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(raw)))
    for a, b, p in zip(order, order[1:], prefix[1:]):
        assert raw[a : a + p] == raw[b : b + p] and (p == 50 or raw[a + p : a + p + 1] != raw[b + p : b + p + 1])


def brute(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    places = {}
    for i, raw in enumerate(texts):
        for k in range(len(raw) - 399):
            places.setdefault(raw[k : k + 400], []).append((i, k))
    gone = [np.zeros(len(raw) + 2, dtype=np.int64) for raw in texts]
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                gone[i][k] += 1
                gone[i][k + 400] -= 1
    out = []
    for (doc, *_), raw, g in zip(rows, texts, gone):
        mask = np.cumsum(g)[: len(raw)] > 0
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        out.append((doc, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cde", "é", "xyz", "q"]) + str(rng.randint(0, 30))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n)[:size] for n, size in [(200, 399), (200, 400), (200, 401), (400, 1100)]]
    rows = []
    for i in range(40):
        parts = [prose(rng.randint(1, 150))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng.randint(1, 60))]
        rows.append((i, "\n".join(parts), ""))
    whole = prose(300)
    rows += [(50, whole, ""), (51, whole, ""), (52, whole + "!", ""), (53, "short", ""), (54, "short", ""), (55, None, ""),
             (56, "", ""), (57, "na" * 700, ""), (58, prose(90) + "-" * 450, ""), (59, passages[3] * 3, "")]
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, sd.suffix_dedup(df).drop("spans").collect()), key=str)


def test_documents_against_brute_force(spark):
    assert run(spark, texts()) == brute(texts())


def test_repeated_rows_missing_ids_and_all_strings_sent(spark, monkeypatch):
    rows = texts(2)[:30]
    rows += [(3, rows[3][1], ""), (4, rows[9][1] + " end", ""), (None, rows[5][1], ""), (None, rows[5][1], ""), (None, rows[6][1] + "x", "")]
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == brute(rows)


def test_hot_anchors(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, f"{i} " * 30 + passage + f" {i * 7}" * 40, "") for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 3000)
    rows = texts(3)
    assert run(spark, rows) == brute(rows)


def test_chunks_of_a_long_text(monkeypatch):
    raw = np.random.default_rng(1).integers(97, 110, 5000).astype(np.uint8)
    whole = [np.concatenate(c) for c in zip(*sd.anchor_runs(raw))]
    monkeypatch.setattr(sd, "CHUNK", 700)
    monkeypatch.setattr(sd, "_POWERS", [])
    parts = [np.concatenate(c) for c in zip(*sd.anchor_runs(raw))]
    spread = lambda r: np.repeat(r[1], 1).tolist() and np.concatenate([np.arange(a, a + n) for a, n in zip(r[1], r[2])]).tolist()
    assert spread(whole) == spread(parts) == list(range(5000 - 399))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_hot_anchor_with_different_neighbours_meets_by_window(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(330))
    texts = ["".join(rng.choice("klmnopqrst ") for _ in range(500)) + line + "".join(rng.choice("uvwxyz ") for _ in range(500)) for _ in range(40)]
    texts += [texts[0][300:1100] + "!", texts[1][480:900] + "?"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").selectExpr("doc", "0L mark", "text")
    raw = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    hot = sorted({int(k) for t in raw[:2] for keys, _, _ in sd.anchor_runs(t) for k in keys})
    got = {(r["doc"], r["at"] + i) for r in sd.hot_runs(df, hot).collect() for i in range(r["n"])}
    seen = {}
    for d, t in enumerate(texts):
        for a in range(len(t) - sd.WINDOW + 1):
            seen.setdefault(t[a : a + sd.WINDOW], []).append((d, a))
    want = {p for places in seen.values() if len(places) > 1 for p in places}
    assert got == want and len({d for d, _ in want}) == 4
