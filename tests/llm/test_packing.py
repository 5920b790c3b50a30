"""Packing: ids equal the tokenizer's, pieces cover documents, bins respect every limit."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing

SCHEMA = "doc_id long, text string, length string"
TEXTS = [
    "Hello, WORLD's end!! it's 42 o'clock 7up", None, "", "naïve Éa ÀÖ×÷ ß ÿ Ÿ ſ K İI ΣΑΣ", "<|endoftext|> x<|startoftext|>y",
    "tab\tnew\nline\x0bv\x0cf\rr nbsp x y \x1cz \x85w é àb", "word " * 5000, "中文字 कि 👩‍👩‍👧 ''s 're", "|| *** $$$a1b2",
    "x" * 3000, "Hello, WORLD's end!! it's 42 o'clock 7up",
]


@pytest.fixture(scope="module")
def reference():
    coder = Tokenizer.from_file(packing.tokenizer_path())
    return lambda t: [*coder.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, texts, reference, tokens=packing.TOKENS, segments=packing.SEGMENTS):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = np.asarray(reference(text), dtype="<u4"), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= tokens and len(members) <= segments
    return sum(r["length"] for r in rows) / (tokens * len(by_bin))


def test_odd_texts(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    check(packing.pack_documents(df, packing.tokenizer_path()).collect(), dict(enumerate(TEXTS)), reference)
    few = packing.pack_documents(df, packing.tokenizer_path(), tokens=64, segments=2).collect()
    check(few, dict(enumerate(TEXTS)), reference, 64, 2)
    assert packing.pack_documents(df.where("false"), packing.tokenizer_path()).collect() == []


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")], SCHEMA)
    rows = packing.pack_documents(df, packing.tokenizer_path()).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", 3), ("1", 3), ("None", 2)]
    assert sorted(r["offset"] for r in rows) in ([0, 3, 6], [0, 2, 5], [0, 3, 5])


def test_given_documents_pack_with_little_padding(spark, folder, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(packing.pack_documents(docs, packing.tokenizer_path()).collect(), texts, reference) > 0.97


def test_all_limits_hold_and_an_oversized_item_is_alone():
    rng = np.random.default_rng(3)
    demands = np.stack([rng.integers(1, 90, 800), np.ones(800, int), rng.integers(0, 40, 800)], axis=1)
    demands[5] = (500, 1, 3)
    capacity = np.array([100, 6, 50])
    bins, places = packing.fill_bins(demands, capacity)
    for b in np.unique(bins):
        mine = bins == b
        assert sorted(places[mine]) == list(range(mine.sum()))
        assert (demands[mine].sum(axis=0) <= capacity).all() or (mine.sum() == 1 and mine[5])
    bound = np.ceil(np.delete(demands, 5, axis=0).sum(axis=0) / capacity).max()
    assert len(np.unique(bins)) <= 1.25 * bound + 2


def test_words_of_latin_letters_go_to_the_model_alone(monkeypatch, reference):
    coder, seen = packing.WordTokenizer(packing.tokenizer_path()), []
    letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    words = [*letters, *(f"ab{c}{d}" for c in letters for d in "zßé"), "Straßen", "DÉJÀ", "açãoñ"]
    whole = coder.tokenizer

    class Recorder:
        model = whole.model

        def encode_batch_fast(self, texts, **kwargs):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **kwargs)

    coder.tokenizer = Recorder()
    got = [np.frombuffer(ids, dtype="<u4").tolist() for ids in coder.ids(words)]
    assert got == [reference(w)[:-1] for w in words]
    assert coder.direct and not seen
