"""MinHash near-dedup against brute force over all pairs."""

import random

import numpy as np
import pytest

from tidemark.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, component_id string"


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Components over rows with distinct ids, by an inverted index and exact sets."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i in sorted(sets):
        common = {}
        for s in sets[i]:
            for j in index.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            index[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def near_copies(seed=2):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Ab", "c", "dé", "EF", "gh", "ij"]) + str(rng.randint(0, 60))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(40)) for _ in range(25)]
    rows += [None, "", " \n", "a b", "A  b", "a b c", "x" * 50_000, " ".join(word() for _ in range(9000))]
    rows += [rows[3], rows[3].upper()]
    rng.shuffle(rows)
    return [(i, t, "clash") for i, t in enumerate(rows)]


def run(spark, rows):
    return sorted(map(tuple, nd.near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


@pytest.mark.parametrize("seed", [2, 3])
def test_components_against_brute_force(spark, seed):
    rows = near_copies(seed)
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, nd.near_dedup(docs).collect())) == want


def test_repeated_and_missing_ids(spark):
    long = " ".join(str(i) for i in range(80))
    rows = [(1, long, ""), (1, "other words here are five now", ""), (2, "other words here are five now", ""),
            (None, long, ""), (None, "alone", ""), (3, long + " end", ""), (3, long + " end", "")]
    got = run(spark, rows)
    assert got == sorted(
        [(1, 76, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 76, 1, True), (None, 1, None, True),
         (3, 77, 1, False), (3, 77, 1, False)], key=str)
    kept = nd.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"]
    assert sorted((str(r[0]) for r in kept.collect())) == ["1", "1", "None", "None"]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    other = base.copy()
    other[:57] = rng.integers(0, 1 << 62, 57, dtype=np.uint64)  # 343 / 457
    same = [(nd.signature(base, seed=s) == nd.signature(other, seed=s)).mean() for s in range(20)]
    assert abs(np.mean(same) - 343 / 457) < 0.03


def test_a_group_whose_first_copy_is_apart(spark):
    """The smallest id of each bucket is near few of the rest, so other classes take the middle in turn."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base[:95] + [f"z{i}" for i in range(25)]))]
    for i in range(1, 60):
        copy = list(base)
        copy[100 + i % 20] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows = [(i, t, "clash") for i, t in rows]
    got = nd.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_bitmaps_bound_the_difference():
    """No two bitmaps differ in more bits than their sets in shingles, so no similar pair is ruled out."""
    rng = np.random.default_rng(4)
    for size in (0, 1, 5, 150, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for gone in {0, size // 10, size}:
            b = np.union1d(a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64))
            apart = sum(int(x).bit_count() for x in (nd.bitmap(a) ^ nd.bitmap(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b))
