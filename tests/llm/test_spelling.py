"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm.spelling import LONGEST_TEXT, spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string, n long"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = [best if best is not None and counts[best] >= 2 * n else None, len(near)]
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, counts[w], k, counts[form] if form else None))
    return sorted(rows)


def brute_counts(rows):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def test_near_words_equal_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for _ in range(30):
        base = "".join(rng.choice("abé÷") for _ in range(rng.choice([5, 6, 7])))
        for _ in range(6):
            i = rng.randrange(len(base) + 1)
            base = rng.choice([base[:i] + rng.choice("abé") + base[i:], base[:i] + "b" + base[i + 1 :], base])
            counts[base] = rng.choice([3, 3, 4, 6, 12, 25])
    for size in range(LONGEST_TEXT - 2, LONGEST_TEXT + 4):
        for c in "aab":
            counts["a" * (size - 1) + c] = size
    counts["x" * 1500], counts["x" * 1499], counts["x" * 700 + "y" + "x" * 799] = 9, 4, 40
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(counts), key=str)


def test_whole_texts(spark):
    rng = random.Random(8)
    words = ["Separate", "seperate", "ÉCOLE", "école", "tables", "table", "word", "Ärger", "colour", "color"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "clash", 1) for i in range(40)]
    rows += [(None, "tables " * 5, None, None), (3, rows[3][1], "x", 0), (50, None, None, 1), (51, "", "", 1)]
    rows.append((52, "x" * 30_000 + " colour-tables9tables", "", 2))
    docs = spark.createDataFrame(rows, SCHEMA)
    counted = word_counts(docs)
    assert {r.word: r.n for r in counted.collect()} == brute_counts(rows)
    got = sorted(map(tuple, spelling_variants(counted).collect()), key=str)
    assert got == sorted(brute(brute_counts(rows)), key=str)


def test_empty_table(spark):
    assert spelling_variants(word_counts(spark.createDataFrame([], SCHEMA))).collect() == []
