"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items are cut into word trigrams (lower-cased, ASCII marks dropped).
How many documents hold each trigram is counted over the whole corpus; a trigram
is a seed of its item if few documents hold it or it belongs to the rarer half of
the item's, so an item that leaked everywhere keeps its seeds.  Where a document
holds a seed, the passage around it is aligned with the whole item, word by word,
and the pair is reported if the local alignment reaches half of the best score
possible: copies, edited copies and paraphrases that keep most words in order.
At least ``LEAST_WORDS`` aligned words are asked for, so an item of no more words than
that must be there word for word; items of one or two words are looked up as they are.
In scripts that do not set spaces between words every character counts as a word.

The benchmark is the small side: it is taken in blocks of at most ``BLOCK_ITEMS``
items, whose seeds and texts go to the tasks; documents are read once to count
and once to align for each block, and never shuffled.

Defined results: null and empty texts match nothing; an item of one or two words
matches every document that holds just these words in a row; rows with one id are reported once, by the
best alignment of either; ids may be null; further columns are not looked at; an
empty table or benchmark gives no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep_rows, prepare, query, table, whole_text

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
LEAST_WORDS = 7
RARE_SHARE = 0.001
RARE_COUNT = 20
BLOCK_ITEMS = 20_000
_MARKS = bytes(32 if chr(c) in string.punctuation else c for c in range(256))
# Letters of scripts without spaces (Thai to Tibetan, Burmese, Khmer, kana, Chinese), and their marks.
_SPACELESS = (
    "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
    "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
)
_WIDE_MARKS = "\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_EITHER = re.compile(f"[{_SPACELESS}{_WIDE_MARKS}]")
_LETTER, _WIDE_MARK = re.compile(f"[{_SPACELESS}]"), re.compile(f"[{_WIDE_MARKS}]")


def words_of(text: str | None) -> list[bytes]:
    lower = (text or "").lower()
    if not lower.isascii() and _EITHER.search(lower):
        lower = _LETTER.sub(r" \g<0> ", _WIDE_MARK.sub(" ", lower))
    return lower.encode().translate(_MARKS).split()


def least_score(words: int, least: float) -> float:
    """The alignment score that an item of so many words must reach."""
    return max(least * MATCH * words, MATCH * min(words, LEAST_WORDS))


@dataclass
class Block:
    """Items as word numbers; ``vocabulary`` numbers their words from 1."""

    ids: list
    items: list[np.ndarray]
    vocabulary: dict[bytes, int]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), dtype=np.int64, count=len(words))

    def grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, place) of the trigrams made of the items' words only."""
        base = len(self.vocabulary) + 1
        a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
        return (a[at] * base + b[at]) * base + c[at], at

    def short_grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram, place) of the single words and pairs made of the items' words only."""
        base = len(self.vocabulary) + 1
        one = np.flatnonzero(numbers > 0)
        two = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
        grams = [numbers[one] * base, numbers[two] * base + numbers[two + 1]]
        return np.concatenate(grams), np.concatenate([one, two])

    def short_items(self) -> tuple[np.ndarray, np.ndarray]:
        """(gram, item) of the items of one or two words, sorted by gram."""
        items = [i for i, numbers in enumerate(self.items) if 0 < len(numbers) < GRAM]
        gram = np.array([self.short_grams(self.items[i])[0][-1] for i in items], dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        return gram[order], np.array(items, dtype=np.int64)[order]


def make_block(rows: list[tuple]) -> Block:
    split = [words_of(text) for _, text in rows]
    vocabulary: dict[bytes, int] = {}
    for words in split:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    block = Block([i for i, _ in rows], [], vocabulary)
    block.items = [block.numbers(words) for words in split]
    return block


def item_grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, item, place) of every trigram of every item, sorted by gram."""
    parts = [(*block.grams(numbers), i) for i, numbers in enumerate(block.items) if len(numbers) >= GRAM]
    if not parts:
        return (np.empty(0, dtype=np.int64),) * 3
    gram = np.concatenate([g for g, _, _ in parts])
    place = np.concatenate([p for _, p, _ in parts])
    item = np.concatenate([np.full(len(g), i) for g, _, i in parts])
    order = np.argsort(gram, kind="stable")
    return gram[order], item[order], place[order]


def document_counts(docs: DataFrame, block: Block, wanted: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the items' trigrams; at most one number per trigram comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for text in batch.column(1):
                gram, _ = block.grams(block.numbers(words_of(text.as_py())))
                if len(gram):
                    gram = np.unique(gram)
                    at = np.minimum(np.searchsorted(wanted, gram), len(wanted) - 1)
                    total[at[wanted[at] == gram]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {int(r["at"]): int(r["n"]) for r in sums.collect()}


def pick_seeds(
    gram: np.ndarray, item: np.ndarray, counts: np.ndarray, documents: int
) -> np.ndarray:
    """Which of the items' trigrams are seeds."""
    seed = counts <= max(RARE_COUNT, RARE_SHARE * documents)
    order = np.lexsort((gram, counts, item))
    begins = np.append(True, item[order][1:] != item[order][:-1]) if len(item) else np.empty(0, dtype=bool)
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, len(order)))
    rank = np.arange(len(order)) - np.repeat(starts, size)
    seed[order] |= rank < np.repeat((size + 1) // 2, size)
    return seed


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(score, end in the passage) of the best local alignment."""
    steps = np.arange(len(passage)) * -GAP
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        here = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(here, 0, out=here)
        above[1:] = np.maximum.accumulate(here + steps) - steps
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def short_matches(block: Block, numbers: np.ndarray, short: tuple) -> Iterator[tuple[int, float, int, int]]:
    """(item, 1, first word, last word) of the items of one or two words in a document, first place of each."""
    keys, items = short
    gram, at = block.short_grams(numbers)
    gram, first = np.unique(gram, return_index=True)
    lo, hi = np.searchsorted(keys, gram), np.searchsorted(keys, gram, side="right")
    for j in np.flatnonzero(hi > lo):
        begin = int(at[first[j]])
        for i in items[lo[j] : hi[j]].tolist():
            yield i, 1.0, begin, begin + len(block.items[i]) - 1


def matches(block: Block, numbers: np.ndarray, seeds: tuple, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, score, first word, last word) of the items found in a document, best passage of each."""
    keys, items, places = seeds
    gram, at = block.grams(numbers)
    lo, hi = np.searchsorted(keys, gram), np.searchsorted(keys, gram, side="right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return
    n = hi[found] - lo[found]
    of = np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(at[found], n) - places[of]
    which = items[of]
    order = np.lexsort((start, which))
    start, which = start[order], which[order]
    lengths = np.array([len(block.items[i]) for i in which])
    split = np.append(True, (which[1:] != which[:-1]) | (np.diff(start) > lengths[1:]))
    heads = np.flatnonzero(split)
    best: dict[int, tuple[float, int, int]] = {}
    for a, b in zip(heads, np.append(heads[1:], len(start))):
        i = int(which[a])
        item = block.items[i]
        slack = len(item) // 2
        first = max(0, int(start[a]) - slack)
        passage = numbers[first : int(start[b - 1]) + len(item) + slack]
        need = least_score(len(item), least)
        if MATCH * np.isin(passage, item).sum() < need:
            continue
        score, end = align(item, passage)
        share = score / (MATCH * len(item))
        if score < need or (i in best and best[i][0] >= share):
            continue
        _, back = align(item[::-1], passage[:end][::-1])
        best[i] = (share, first + end - back, first + end - 1)
    for i, (share, begin, last) in sorted(best.items()):
        yield i, share, begin, last


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = LEAST_SCORE,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of the documents that hold a benchmark item."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("long").alias("item_id"), whole_text(item_text_col).alias("text")
    ).distinct()
    blocks = -(-items.count() // BLOCK_ITEMS)
    documents = rows.count()
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    out = spark.createDataFrame([], schema)
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        block = make_block([tuple(r) for r in part.orderBy("item_id", "text").collect()])
        gram, item, place = item_grams(block)
        short = block.short_items()
        if not len(gram) and not len(short[0]):
            continue
        wanted = np.unique(gram)
        counts = np.zeros(len(wanted), dtype=np.int64)
        for at, n in (document_counts(rows, block, wanted) if len(gram) else {}).items():
            counts[at] = n
        seed = pick_seeds(gram, item, counts[np.searchsorted(wanted, gram)], documents)
        out = out.union(rows.mapInArrow(_finder(spark, block, (gram[seed], item[seed], place[seed]), short, least), schema))
    top = F.max(F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("t")
    return out.groupBy("doc_id", "item_id").agg(top).select(
        "doc_id",
        "item_id",
        F.round("t.score", 4).alias("score"),
        (-F.col("t.col2")).alias("first_word"),
        (-F.col("t.col3")).alias("last_word"),
    )


def _finder(spark, block: Block, seeds: tuple, short: tuple, least: float):
    held = spark.sparkContext.broadcast((block.ids, block.items, block.vocabulary, seeds, short))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, vocabulary, keys, brief = held.value
        own = Block(ids, items, vocabulary)
        names = ["doc_id", "item_id", "score", "first_word", "last_word"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                numbers = own.numbers(words_of(text.as_py()))
                found = list(matches(own, numbers, keys, least))
                if len(brief[0]):
                    found += short_matches(own, numbers, brief)
                for i, share, begin, last in found:
                    for column, value in zip(out, (doc.as_py(), ids[i], share, begin, last)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without a benchmark item in them; rows without an id are judged by their text."""
    found = contaminated(docs, benchmark, id_col, text_col)
    kept = keep_rows(docs, id_col, found.select(F.col("doc_id").alias("id")), keep=False)
    lone = docs.where(F.col(f"`{id_col}`").isNull())
    if lone.isEmpty():
        return kept
    # give rows without an id one by their text, and judge those
    keyed = lone.withColumn("__key", F.xxhash64(F.lit("lone"), whole_text(text_col)))
    bad = contaminated(keyed.select(F.col("__key").alias("doc_id"), whole_text(text_col).alias("text")), benchmark)
    clean = keep_rows(keyed, "__key", bad.select(F.col("doc_id").alias("id")), keep=False).drop("__key")
    return kept.where(F.col(f"`{id_col}`").isNotNull()).unionByName(clean)


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
