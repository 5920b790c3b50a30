r"""Substring dedup: word windows that an earlier document already has are removed.

Words are ``[^\x20\x09-\x0D]+`` and a window is 13 consecutive words of one
document.  Consecutive windows that share a minimiser (the run of five words with
the smallest hash among those of the window) travel together as one packed string, a
super-k-mer, to the minimiser's bucket.  Equal windows have equal minimisers, so
they meet; there the windows of a bucket are sorted, and the smallest document of
each window sequence is found exactly, bytes compared.  Minimisers are counted
first: one that lies in a single document cannot bring windows together, so its
super-k-mers stay at home.  The shared ones are sent to the tasks while they fit
``BROADCAST_BYTES``; beyond that every super-k-mer travels.

Skew: equal texts are found first by digest; one of them takes part and the others
are known to be covered.  A minimiser that holds more than a quarter of a
partition's share of the windows that travel is hot; there are at most four
per shuffle partition.  Its windows are not gathered by bucket: each is a key of its own, the
smallest document comes from a partial aggregation, and a join brings it back to
the occurrences: by broadcast below a checked size, else by a shuffle, which
adaptive execution can split.

Defined results: a null or empty text has no words; a document with fewer words
than a window loses nothing; rows without an id count as later than all others;
rows with the same id do not take words from each other; further columns are not
looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, freeze, prepare, query, shuffle_parts, table, whole_text

WINDOW = 13
# Long enough that texts of common words seldom share one by chance: what is shared by chance travels for nothing.
GRAM = 5
SPAN = WINDOW - GRAM + 1
# Texts are hashed together until so many bytes are at hand.
CHUNK_BYTES = 1 << 20
# Minimisers are merged within a task once so many are at hand, and strings leave it by so many.
COUNT_ROWS = 1_000_000
BATCH_KMERS = 20_000
# Buckets are judged together until so many super-k-mers are at hand.
BLOCK_ROWS = 8_000
NO_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, at least ``size`` of each."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS.clear()
        for base in (ODD, np.uint64(pow(int(ODD), -1, 1 << 64))):
            power = np.full(max(size, CHUNK_BYTES), base)
            power[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(power, out=power)
            _POWERS.append(power)
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def _places(blob: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, 64-bit hash) of the words of bytes that end with white space, a piece of whole words at a time."""
    at = 0
    while at < len(blob):
        size = CHUNK_BYTES
        space = _SPACE[blob[at : at + size]]
        while not space.any():  # a word longer than a piece
            size *= 2
            space = _SPACE[blob[at : at + size]]
        upto = len(space) - int(space[::-1].argmax())
        edges = np.diff(space[:upto].view(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        power, inverse = _powers(upto)
        with np.errstate(over="ignore"):
            sums = np.zeros(upto + 1, dtype=np.uint64)
            np.cumsum((blob[at : at + upto] + np.uint64(7)) * power[:upto], dtype=np.uint64, out=sums[1:])
            hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts])
        yield starts + at, ends + at, hashes
        at += upto


def word_hashes(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end and 64-bit hash of each word in them, words up to the end of each text) of joined texts."""
    raw = b"\n".join(texts) + b"\n"
    starts, ends, hashes = map(np.concatenate, zip(*_places(np.frombuffer(raw, dtype=np.uint8))))
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return raw, starts, ends, hashes, upto


def gram_hashes(hashes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` words, which orders them."""
    n = len(hashes) - gram + 1
    with np.errstate(over="ignore"):
        grams = hashes[:n].copy()
        for j in range(1, gram):
            grams = (grams ^ (grams >> np.uint64(29))) * ODD + hashes[j : n + j]
        return _mixed(grams)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values."""
    out, width = values, 1
    while 2 * width <= span:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    return out if width == span else np.minimum(out[: len(values) - span + 1], out[span - width :])


def minimisers(hashes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, text, first word, windows) of the super-k-mers of joined texts; none holds over ``SPAN`` windows."""
    inside = np.ones(max(0, len(hashes) - WINDOW + 1), dtype=bool)
    for j in range(1, WINDOW):  # a window ends with its text
        late = upto - j
        inside[late[(late >= 0) & (late < len(inside))]] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at, at, at
    least = _least(gram_hashes(hashes), SPAN)[at]
    new = np.append(True, (least[1:] != least[:-1]) | (np.diff(at) != 1))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    parts = -(-n // SPAN)
    if parts.max() > 1:  # one gram repeated on and on
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + k * SPAN, np.minimum(np.repeat(n, parts) - k * SPAN, SPAN)
    return least[first], np.searchsorted(upto, at[first], side="right"), at[first], n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(documents, row marks, texts) of rows with about ``CHUNK_BYTES`` of text, those too short for a window left out."""
    docs, marks, texts, size = [], [], [], 0
    for batch in batches:
        for doc, mark, text in zip(*(batch.column(i) for i in range(3))):
            raw = text.as_py().encode()
            if len(raw) < 2 * WINDOW - 1:
                continue
            docs.append(doc.as_py())
            marks.append(mark.as_py())
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield np.array(docs), np.array(marks), texts
                docs, marks, texts, size = [], [], [], 0
    if texts:
        yield np.array(docs), np.array(marks), texts


def shared_minimisers(rows: DataFrame) -> DataFrame:
    """(key, n) of the minimisers that lie in more than one document; n counts their windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for docs, _, texts in _chunks(batches):
            keys, of, _, n = minimisers(*word_hashes(texts)[3:])
            held.append((keys, docs[of], n))
            size += len(keys)
            if size >= COUNT_ROWS:
                yield grouped(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield grouped(*map(np.concatenate, zip(*held)))

    def grouped(keys: np.ndarray, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys, docs = keys[order], docs[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums, lo, hi = np.add.reduceat(n[order], first), np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
        columns = [pa.array(c, pa.int64()) for c in (keys[first].view(np.int64), sums, lo, hi)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "n", "lo", "hi"])

    sums = rows.mapInArrow(count, "key long, n long, lo long, hi long").groupBy("key")
    sums = sums.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return freeze(sums.where("lo < hi").select("key", "n"))


def hot_minimisers(shared: DataFrame, parts: int) -> list[int]:
    """Minimisers of more than 1 / (4 * parts) of what travels: fewer than 4 * parts."""
    total = shared.agg(F.sum("n")).first()[0] or 0
    return [r["key"] for r in shared.where(F.col("n") > max(2, total / (4 * parts))).select("key").collect()]


def _keys(values) -> np.ndarray:
    return np.sort(np.asarray(values, dtype=np.int64).view(np.uint64))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def super_kmers(rows: DataFrame, shared: DataFrame, hot: list[int]) -> DataFrame:
    """(key, doc, mark, at, packed) of the super-k-mers whose minimiser is shared and not hot."""
    sc, hot_keys = rows.sparkSession.sparkContext, _keys(hot)
    few = shared.count() * 8 <= BROADCAST_BYTES
    held = sc.broadcast(_keys(shared.select("key").toArrow().column("key").to_numpy())) if few else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, marks, texts in _chunks(batches):
            raw, starts, ends, hashes, upto = word_hashes(texts)
            keys, of, first, n = minimisers(hashes, upto)
            own = ~_among(keys, hot_keys)
            if held is not None:
                own &= _among(keys, held.value)
            own = np.flatnonzero(own)
            for i in range(0, len(own), BATCH_KMERS):
                part = own[i : i + BATCH_KMERS]
                text, word = of[part], first[part]
                a, b = starts[word], ends[word + n[part] + WINDOW - 2]
                at = word - np.append(0, upto)[text]
                columns = [pa.array(c, pa.int64()) for c in (keys[part].view(np.int64), docs[text], marks[text], at)]
                columns.append(pa.array(_packed(raw, a, b), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "mark", "at", "packed"])

    return rows.mapInArrow(cut, "key long, doc long, mark long, at long, packed binary")


def _packed(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words between each start and end, joined by one space."""
    return [b" ".join(raw[a:b].split()) for a, b in zip(starts.tolist(), ends.tolist())]


def judge_block(doc: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window in it, number) of the runs of windows that also start in a smaller document."""
    blob = np.frombuffer(b" ".join(packed) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(blob == 32)
    starts = np.append(0, ends[:-1] + 1)
    size = np.array([len(p) + 1 for p in packed])
    last = np.cumsum(size)
    # words of each row, then the windows: (row, first word)
    upto = np.searchsorted(ends, last - 1, side="right")
    n = np.diff(upto, prepend=0) - WINDOW + 1
    row = np.repeat(np.arange(len(packed)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    word = np.repeat(upto - n - WINDOW + 1, n) + inside
    a, b = starts[word], ends[word + WINDOW - 1]
    with np.errstate(over="ignore"):
        power = np.full(len(blob) + 1, BASE, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.append(np.uint64(0), np.cumsum((blob.astype(np.uint64) + np.uint64(7)) * power[:-1], dtype=np.uint64))
        key = (sums[b] - sums[a]) * power[len(blob) - a]
    docs = doc[row]
    order = np.lexsort((docs, key))
    new = np.append(True, key[order][1:] != key[order][:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = docs[order] > docs[head]
    hit, of = order[later], head[later]
    covered = np.zeros(len(row), dtype=bool)
    raw = blob.tobytes()
    same = [raw[p:q] == raw[r:s] for p, q, r, s in zip(a[hit].tolist(), b[hit].tolist(), a[of].tolist(), b[of].tolist())]
    covered[hit] = same
    if not all(same):
        # windows of one hash that differ: judge those hashes by the bytes themselves
        for k in np.unique(key[hit[~np.array(same)]]):
            firsts: dict[bytes, int] = {}
            mine = np.flatnonzero(key == k)
            for i in mine:
                text = raw[a[i] : b[i]]
                firsts[text] = min(firsts.get(text, NO_ID), int(docs[i]))
            for i in mine:
                covered[i] = docs[i] > firsts[raw[a[i] : b[i]]]
    at = np.flatnonzero(covered)
    if not len(at):
        return at, at, at
    begins = np.append(True, (np.diff(at) != 1) | (np.diff(row[at]) != 0))
    runs = at[begins]
    return row[runs], inside[runs], np.diff(np.append(np.flatnonzero(begins), len(at)))


def covered_runs(kmers: DataFrame, parts: int) -> DataFrame:
    """(doc, mark, at, n): runs of windows that start in a smaller document too."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            block = pa.Table.from_batches(held)
            key = block.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield from runs(block.slice(0, cut))
            held, rows = block.slice(cut).to_batches(), len(key) - cut
        if held:
            yield from runs(pa.Table.from_batches(held))

    def runs(block: pa.Table) -> Iterator[pa.RecordBatch]:
        if not block.num_rows:
            return
        doc, mark, at = (block.column(c).to_numpy() for c in ("doc", "mark", "at"))
        row, inside, n = judge_block(doc, block.column("packed").to_pylist())
        columns = [doc[row], mark[row], at[row] + inside, n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["doc", "mark", "at", "n"]
        )

    bucketed = kmers.repartition(parts, "key").sortWithinPartitions("key")
    return bucketed.mapInArrow(judge, "doc long, mark long, at long, n long")


def hot_runs(rows: DataFrame, hot: list[int]) -> DataFrame:
    """(doc, mark, at, n) for the windows of hot minimisers."""
    hot_keys = _keys(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, marks, texts in _chunks(batches):
            raw, starts, ends, hashes, upto = word_hashes(texts)
            keys, of, first, n = minimisers(hashes, upto)
            own = _among(keys, hot_keys)
            of, first, n = of[own], first[own], n[own]
            words = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(of, n)
            for i in range(0, len(words), BATCH_KMERS):
                word, text = words[i : i + BATCH_KMERS], of[i : i + BATCH_KMERS]
                at = word - np.append(0, upto)[text]
                columns = [pa.array(c, pa.int64()) for c in (docs[text], marks[text], at)]
                columns.append(pa.array(_packed(raw, starts[word], ends[word + WINDOW - 1]), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "at", "packed"])

    windows = rows.mapInArrow(cut, "doc long, mark long, at long, packed binary")
    first = windows.groupBy("packed").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first")
    stored = freeze(first.drop("last"))
    width = stored.agg(F.sum(F.length("packed") + 48)).first()[0] or 0
    few = F.broadcast(stored) if width <= BROADCAST_BYTES else stored
    return windows.join(few, "packed").where("doc > first").select("doc", "mark", "at", F.lit(1).cast("long").alias("n"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row; ``kept`` is the text that remains."""
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_parts(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    repeated = base.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    # rows with one id are told apart by their texts, where ids repeat at all
    mark = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    rows = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), mark.alias("mark"), "text", "doc_id")

    digests = freeze(rows.select("doc", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    firsts = digests.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first")
    copies = freeze(digests.join(firsts, "sha").where("doc > first").select("doc", "mark").distinct())
    few = F.broadcast(copies) if copies.count() * 32 <= BROADCAST_BYTES else copies
    own = rows.join(few, ["doc", "mark"], "left_anti").select("doc", "mark", "text")

    shared = shared_minimisers(own)
    hot = hot_minimisers(shared, parts)
    runs = covered_runs(super_kmers(own, shared, hot), parts)
    if hot:
        runs = runs.union(hot_runs(own, hot))
    runs = runs.union(copies.select("doc", "mark", F.lit(0).cast("long"), F.lit(NO_ID // 2)))
    cuts = freeze(_joined(runs).groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    width = cuts.agg(F.sum(F.size("runs") * 16 + 48)).first()[0] or 0
    return _cut(rows.join(F.broadcast(cuts) if width <= BROADCAST_BYTES else cuts, ["doc", "mark"], "left"))


def _joined(runs: DataFrame) -> DataFrame:
    """Runs of one document whose words touch made one, in one pass over its sorted runs."""
    ordered = Window.partitionBy("doc", "mark").orderBy("at", "n")
    reached = F.max(F.col("at") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = reached.isNull() | (F.col("at") > reached + (WINDOW - 1))
    joined = runs.withColumn("opens", opens.cast("long")).withColumn("run", F.sum("opens").over(ordered))
    ends = F.max(F.col("at") + F.col("n"))
    return joined.groupBy("doc", "mark", "run").agg(F.min("at").alias("at"), (ends - F.min("at")).alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, runs = batch.columns
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                words = texts[i].as_py().encode().split()
                n, found = len(words), runs[i].as_py()
                if found and n >= WINDOW:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    for r in found:
                        edge[r["at"]] += 1
                        edge[min(n, r["at"] + r["n"] + WINDOW - 1)] -= 1
                    left = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, left.tolist()) if k]
                kept = b" ".join(words)
                for column, value in zip(
                    out, (docs[i].as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())
                ):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return rows.select("doc_id", "text", "runs").mapInArrow(cut, schema)


@query(
    "op7_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
    f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (s) WHERE doc_id > first),
    o AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    k AS (SELECT o.doc_id, count(r.p) AS n_removed,
                 string_agg(CASE WHEN r.p IS NULL THEN word END, ' ' ORDER BY o.p) AS kept
          FROM o LEFT JOIN r ON o.doc_id = r.doc_id AND o.p = r.p GROUP BY o.doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
)
def op7_substring_dedup(spark, folder):
    return substring_dedup(table(spark, folder, "documents")).drop("kept")
