"""The pipeline: stages chained by tables, each judged by brute force on what it was given."""

import random

import corpus_pipeline as cp
from tidemark.llm import packing
from test_near_dedup import brute as near_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [text(30) for _ in range(5)]
    rows = [text(rng.choice([8, 60, 300])) for _ in range(60)]
    rows += [rows[3], rows[3], rows[7] + " more", items[1], text(20) + " " + items[2] + " " + text(20), None, "", "#### 12 %%"]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)]
    return docs, list(enumerate(items))


def test_stages_in_turn(spark, tmp_path):
    docs, items = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = {d[0]: d[1] for d in docs}
    state = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"] for r in state.collect()}
        state = spark.createDataFrame([d for d in docs if d[0] in kept[name]], COLUMNS)
    assert set(texts) - kept["language_id"] == {65, 66, 67}
    assert kept["language_id"] - kept["exact_dedup"] == {3, 60}
    near = near_brute([(i, texts[i]) for i in sorted(kept["exact_dedup"])])
    assert kept["near_dedup"] == {i for i, *_, stays in near if stays}
    assert kept["near_dedup"] - kept["decontamination"] == {63, 64}
    packed = cp.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == kept["decontamination"]
    assert all(r["length"] <= packing.TOKENS for r in packed)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
