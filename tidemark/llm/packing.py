"""Packing tokenized documents into sequences by vector bin packing.

A document's ids are cut into full sequences and one shorter piece.  Pieces are
items with three demands (tokens, one segment, loss-bearing tokens); bins have a
capacity in each.  A bin is filled by the dot-product heuristic: among the items
that still fit, the one whose demands have the largest dot product with the
bin's remaining capacities goes in, until none fits; then the next bin opens.

Pieces are dealt by hash into shards of some thousand, each packed on its own in
one group of bounded size, so nothing meets in one place; a shard wastes at most
its last bins.  Equal demands are one class with a counter, so a step looks at
classes, not items.

Defined results: a null text is empty and becomes the end id alone; a repeated row
is a document of its own; null ids stay null; an empty table gives no rows;
further columns are not looked at.  A document's ids may be of any number.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import freeze, prepare, query, table, whole_text

TOKENS = 2048
SEGMENTS = 256
END_ID = 1
SHARD_ITEMS = 4096

# A Python worker's cache has two generations of at most so many words, and as many pieces of words.
WORDS_KEPT = 150_000
# A word of these letters followed by ASCII marks is letters and marks to the tokenizer, each encoded by itself.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
# What such letters are after lower-casing, and the characters that stand for their bytes in a byte-level model.
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Memory:
    """A bounded cache: what is not asked for while a generation fills is forgotten with it."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def unknown(self, keys: set) -> list:
        """The keys that have to be added; known ones are moved to the young generation."""
        if len(self.young) > WORDS_KEPT:
            self.old, self.young = self.young, {}
        missing = []
        for key in keys.difference(self.young):
            if key in self.old:
                self.young[key] = self.old[key]
            else:
                missing.append(key)
        return missing


class WordTokenizer:
    """Token ids of whole texts from a tokenizer file that splits at white space.

    Every word is encoded by the tokenizer itself; ids of words seen before are
    taken from a cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.words, self.pieces = Memory(), Memory()
        sample = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7] + ["straße", "déjà", "año"]
        found = self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)
        # whether the model, given the bytes of letters, says what the whole tokenizer says
        self.direct = all(self._model(p) == _bytes(f.ids) for p, f in zip(sample, found))

    def _model(self, letters: str) -> bytes:
        """Ids of lower-case letters by the model alone, without normalizer and splitter."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_CHARS)
        return _bytes([t.id for t in self.tokenize(letters)])

    @staticmethod
    def _split(word: bytes) -> list[str]:
        text = word.decode()
        plain = PLAIN_WORD.fullmatch(text)
        if plain is None:
            return [text]
        return [p for p in (plain[1].lower(), plain[2]) if p]

    def learn(self, words: set[bytes]) -> None:
        new = self.words.unknown(words)
        alone, mixed = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        lower, parts = b" ".join(alone).lower().decode().split(), list(map(self._split, mixed))
        missing = self.pieces.unknown(set(lower).union(*parts))
        # lower-case letters reach the model as they are, or as their bytes
        plain = [p for p in missing if LETTERS.fullmatch(p) and (self.direct or p.isascii())]
        self.pieces.young.update([(p, self._model(p)) for p in plain])
        other = list(set(missing).difference(plain))
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        self.pieces.young.update(zip(other, [_bytes(f.ids) for f in found]))
        get = self.pieces.young.__getitem__
        self.words.young.update(zip(alone, map(get, lower)))
        self.words.young.update(zip(mixed, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.encode().split() for t in texts]
        self.learn(set().union(*split))
        get = self.words.young.__getitem__
        for words in split:
            yield b"".join(map(get, words))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    prepare(docs.sparkSession)
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), coder.ids(part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, tokens):
                        piece = ids[4 * start : 4 * (start + tokens)]
                        row = (doc, start, len(piece) // 4, zlib.crc32(piece), total)
                        for column, value in zip(out, row):
                            column.append(value)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
        # the worker stays for other tasks: only the recent words are worth their memory
        coder.words.old, coder.pieces.old = {}, {}

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(cut, schema)


def fill_bins(demands: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each item; ``demands`` has a row per item, ``capacity`` one number per column.

    An item that exceeds the capacity by itself gets a bin of its own.
    """
    classes, of, counts = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(of.ravel(), kind="stable")
    nexts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    columns, scaled = [np.ascontiguousarray(c) for c in classes.T], classes / capacity
    bins, places = np.empty(len(demands), dtype=np.int64), np.empty(len(demands), dtype=np.int64)
    number, open_ = 0, np.arange(len(classes))
    while len(open_):
        rest, place, live = capacity.tolist(), 0, open_
        while len(live):
            score = scaled[live] @ np.array([r / c for r, c in zip(rest, capacity.tolist())])
            fits = np.ones(len(live), dtype=bool)
            for column, r in zip(columns, rest):
                fits &= column[live] <= r
            if fits.any():
                live, score = live[fits], score[fits]
            elif place:
                break
            best = int(live[score.argmax()])
            item = order[nexts[best]]
            bins[item], places[item] = number, place
            nexts[best] += 1
            counts[best] -= 1
            rest = [r - int(c[best]) for r, c in zip(rest, columns)]
            place += 1
            if not counts[best]:
                live, open_ = live[live != best], open_[open_ != best]
            if min(rest) < 0 or rest[0] == 0:
                break
        number += 1
    return bins, places


def pack_pieces(
    pieces: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int = TOKENS, loss_col: str = "length"
) -> DataFrame:
    """Add sequence_id and offset to pieces; ``loss_col`` says how many tokens of a piece bear loss."""
    prepare(pieces.sparkSession)
    stored = freeze(pieces)
    shards = max(1, stored.count() // SHARD_ITEMS)
    capacity = np.array([tokens, segments, loss_tokens])

    def fill(part: pa.Table) -> pa.Table:
        part = part.sort_by([(n, "ascending") for n in ("doc_id", "start", "ids_crc32")])
        length = part.column("length").to_numpy()
        demands = np.stack([length, np.ones_like(length), part.column(loss_col).to_numpy()], axis=1)
        bins, places = fill_bins(demands, capacity)
        order = np.lexsort((places, bins))
        inside = np.cumsum(length[order]) - length[order]
        first = np.flatnonzero(places[order] == 0)
        offset = np.empty_like(length)
        offset[order] = inside - np.repeat(inside[first], np.diff(np.append(first, len(order))))
        shard = part.column("shard").to_numpy()
        part = part.drop_columns(["shard"])
        part = part.append_column("sequence_id", pa.array((shard << 32) + bins, pa.int64()))
        return part.append_column("offset", pa.array(offset, pa.int64()))

    dealt = stored.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return dealt.groupBy("shard").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = TOKENS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """Cut and pack documents whose tokens all bear loss: one row per piece."""
    return pack_pieces(cut_documents(docs, tokenizer, id_col, text_col, tokens), tokens, segments, tokens)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_packing")
def op5_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"), tokenizer_path())
