"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere go.

Texts are UTF-8 bytes.  Every 400-byte window has an anchor, the smallest of the
hashed 80-byte strings inside it, so equal windows have equal anchors and meet in
the anchor's shard: consecutive windows with one anchor travel as one string.
Anchors are counted first; one that occurs once cannot belong to a repeated
window, so its strings stay at home.  The shared anchors are sent to the tasks
while they fit ``BROADCAST_BYTES``; beyond that all strings travel.

A shard takes its anchors in blocks.  Equal strings of a block become one with a
count, and the block's suffix order and common prefixes come from external induced
sorting (see ``induced_sort``); a window is repeated if its string counts twice or
a neighbour in suffix order shares 400 bytes.  A block holds whole anchors and
grows only with the distinct strings of one anchor, its queues lie on disk beyond
a bound.

Skew: texts that are equal as a whole are found by digest first; one of them takes
part, all are covered whole.  An anchor with more than a share of 1 / (4 * partitions)
is hot: its windows are not gathered by anchor.  Each is a key of its own, by a 128-bit
digest; windows are counted by a partial aggregation, and those that occur twice come
back to their places by broadcast below a checked size, else by a join that adaptive
execution can split.

Defined results: a null or empty text has no bytes; a text shorter than a window
loses nothing; repeated rows are places of their own, so each loses what the other
has; ids may be null; further columns are not looked at; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, broadcast_if_small, freeze, prepare, query, shuffle_parts, table, whole_text
from tidemark.llm.induced_sort import suffix_order

WINDOW = 400
CONTEXT = 80
SPAN = WINDOW - CONTEXT + 1
CHUNK = 1 << 20
BLOCK_BYTES = 2 << 20
WHOLE = 1 << 60
NO_ID = (1 << 63) - 1

_POWERS: list[np.ndarray] = []


def _powers() -> np.ndarray:
    if not _POWERS:
        with np.errstate(over="ignore"):
            power = np.full(CHUNK + WINDOW + 1, np.uint64(0x100000001B3))
            power[0] = 1
            np.multiply.accumulate(power, out=power)
        _POWERS.append(power)
    return _POWERS[0]


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values, by running minima inside blocks from both sides."""
    n = len(values) - span + 1
    rows = -(-len(values) // span)
    blocks = np.full(rows * span, np.uint64((1 << 64) - 1))
    blocks[: len(values)] = values
    blocks = blocks.reshape(rows, span)
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(down[:n], up[span - 1 : span - 1 + n])


def _chunks(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, hash of the context at each place, anchor of each window) of the chunks of a text."""
    power = _powers()
    for at in range(0, len(raw) - WINDOW + 1, CHUNK):
        part = raw[at : at + CHUNK + WINDOW - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(13)) * power[: len(part)], dtype=np.uint64, out=sums[1:])
            starts = len(part) - CONTEXT + 1
            h = (sums[CONTEXT:] - sums[:starts]) * power[len(power) - starts :][::-1]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        yield at, h, _least(h, SPAN)


def anchor_runs(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, windows) of the runs of windows with one anchor, chunk by chunk."""
    for at, _, least in _chunks(raw):
        first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        yield least[first].view(np.int64), first + at, np.diff(np.append(first, len(least)))


def anchor_counts(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor, places that have its hash), chunk by chunk; places where chunks overlap count twice."""
    for _, h, least in _chunks(raw):
        keys = np.unique(least[np.append(True, least[1:] != least[:-1])])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        yield keys.view(np.int64), np.bincount(at[keys[at] == h], minlength=len(keys))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(document, row mark, bytes) of every text with a window."""
    for batch in batches:
        docs, marks, texts = batch.columns
        for i in range(batch.num_rows):
            raw = texts[i].as_py().encode()
            if len(raw) >= WINDOW:
                yield docs[i].as_py(), marks[i].as_py(), raw


def shared_anchors(rows: DataFrame) -> DataFrame:
    """(key, n) of the anchors that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, size = [], [], 0
        for _, _, raw in _texts(batches):
            for key, n in anchor_counts(np.frombuffer(raw, dtype=np.uint8)):
                held.append(key)
                times.append(n)
                size += len(key)
            if size > 2_000_000:
                yield grouped(held, times)
                held, times, size = [], [], 0
        if held:
            yield grouped(held, times)

    def grouped(held: list, times: list) -> pa.RecordBatch:
        keys, of = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(times)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    sums = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return freeze(sums.where("n > 1"))


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def strings(rows: DataFrame, picked: np.ndarray | None, but: list[int]) -> DataFrame:
    """(key, doc, mark, at, packed) of the runs whose anchor is among ``picked`` (None: any) and not in ``but``."""
    held = rows.sparkSession.sparkContext.broadcast(picked) if picked is not None else None
    left_out = np.sort(np.array(but, dtype=np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        for doc, mark, raw in _texts(batches):
            for keys, first, n in anchor_runs(np.frombuffer(raw, dtype=np.uint8)):
                own = ~_among(keys, left_out)
                if held is not None:
                    own &= _among(keys, held.value)
                for k, a, b in zip(keys[own].tolist(), first[own].tolist(), (first + n)[own].tolist()):
                    for column, value in zip(out, (k, doc, mark, a, raw[a : b + WINDOW - 1])):
                        column.append(value)
            if len(out[0]) > 5_000:
                yield batch(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield batch(out)

    def batch(out: list[list]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "mark", "at", "packed"])

    return rows.mapInArrow(cut, "key long, doc long, mark long, at long, packed binary")


def repeated_runs(packed: list[bytes], times: np.ndarray) -> list[tuple[int, int, int]]:
    """(string, window, windows) of the runs of repeated windows of distinct strings.

    ``times`` says how often each string occurs.
    """
    text = np.frombuffer(b"\xff".join(packed) + b"\xff", dtype=np.uint8)  # no UTF-8 text has this byte
    sizes = np.array([len(p) for p in packed])
    ends = np.cumsum(sizes + 1) - 1
    order, prefix = suffix_order(text, WINDOW)
    long = prefix >= WINDOW
    again = np.zeros(len(text), dtype=bool)
    again[order[long]] = True
    again[order[:-1][long[1:]]] = True
    out = []
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        windows = size - WINDOW + 1
        if times[i] > 1:
            out.append((i, 0, windows))
            continue
        mine = again[end - size : end - size + windows]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        out += [(i, int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole keys at a time, of sorted batches, with about BLOCK_BYTES of strings."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            size += part.column(part.schema.get_field_index("packed")).nbytes
            if size < BLOCK_BYTES:
                continue
            block = pa.Table.from_batches(held)
            key = block.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield block.slice(0, cut)
                rest = block.slice(cut).combine_chunks()
                held, size = rest.to_batches(), rest.column("packed").nbytes
    if held:
        yield pa.Table.from_batches(held)


def covered_runs(found: DataFrame, parts: int) -> DataFrame:
    """(doc, mark, at, n): runs of windows that start elsewhere too."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            if not block.num_rows:
                continue
            number: dict[bytes, int] = {}
            of = np.array([number.setdefault(p, len(number)) for p in block.column("packed").to_pylist()])
            runs = repeated_runs(list(number), np.bincount(of))
            if not runs:
                continue
            i, a, n = (np.array(c) for c in zip(*runs))
            # every occurrence of a string gets the runs of that string
            lo, hi = np.searchsorted(i, of), np.searchsorted(i, of, side="right")
            row = np.repeat(np.arange(len(of)), hi - lo)
            run = np.repeat(lo, hi - lo) + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            doc, mark, at = (block.column(c).to_numpy()[row] for c in ("doc", "mark", "at"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (doc, mark, at + a[run], n[run])], names=["doc", "mark", "at", "n"]
            )

    sharded = found.repartition(parts, "key").sortWithinPartitions("key")
    return sharded.mapInArrow(judge, "doc long, mark long, at long, n long")


def hot_runs(rows: DataFrame, hot: list[int]) -> DataFrame:
    """(doc, mark, at, n) for the windows of hot anchors; each window is a key of its own, by a 128-bit digest."""
    held = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, dtype=np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, mark, raw in _texts(batches):
            for keys, first, n in anchor_runs(np.frombuffer(raw, dtype=np.uint8)):
                own = _among(keys, held.value)
                if not own.any():
                    continue
                places = np.concatenate([np.arange(a, a + m) for a, m in zip(first[own].tolist(), n[own].tolist())])
                for i in range(0, len(places), 20_000):
                    at = places[i : i + 20_000]
                    digests = [xxhash.xxh3_128_digest(raw[a : a + WINDOW]) for a in at.tolist()]
                    ids = [pa.array(np.full(len(at), x), pa.int64()) for x in (doc, mark)]
                    columns = [*ids, pa.array(at, pa.int64()), pa.array(digests, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "at", "window"])

    def touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, at = (c.to_numpy() for c in batch.columns)
            if not len(at):
                continue
            goes_on = (doc[1:] == doc[:-1]) & (mark[1:] == mark[:-1]) & (at[1:] == at[:-1] + 1)
            first = np.flatnonzero(np.append(True, ~goes_on))
            columns = [doc[first], mark[first], at[first], np.diff(np.append(first, len(at)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "mark", "at", "n"])

    windows = rows.mapInArrow(cut, "doc long, mark long, at long, window binary")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window")
    few = broadcast_if_small(freeze(again), 64)
    found = windows.join(few, "window").select("doc", "mark", "at")
    return found.mapInArrow(touching, "doc long, mark long, at long, n long")


def _joined(runs: Column) -> Column:
    """Runs of one text in order, those whose bytes touch made one."""
    kind = "array<struct<at:bigint,n:bigint>>"

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["at"] + last["n"], run["at"] + run["n"])
        longer = F.array(F.struct(last["at"].alias("at"), (end - last["at"]).alias("n")))
        touches = run["at"] <= last["at"] + last["n"] + (WINDOW - 1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), longer)
        joined = F.when(F.size(done) == 0, F.array(run)).when(touches, grown)
        return joined.otherwise(F.concat(done, F.array(run))).cast(kind)

    return F.aggregate(F.sort_array(runs), F.expr(f"cast(array() as {kind})"), add)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row.

    ``spans`` lists the removed (start, length) runs of bytes.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = shuffle_parts(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    odd = base.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    # rows with one id are told apart by their texts, where ids repeat at all
    mark = F.xxhash64("text") if odd else F.lit(0).cast("long")
    rows = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), mark.alias("mark"), "text", "doc_id")

    digests = freeze(rows.select("doc", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
    groups = digests.groupBy("sha").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = freeze(digests.join(groups, "sha").select("doc", "mark", (F.col("doc") > F.col("first")).alias("later")).distinct())
    later = broadcast_if_small(freeze(copies.where("later").select("doc", "mark")), 32)
    own = rows.join(later, ["doc", "mark"], "left_anti").select("doc", "mark", "text")

    shared = shared_anchors(own)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = [r["key"] for r in shared.where(F.col("n") > max(2, total / (4 * parts))).select("key").collect()]
    known = None
    if shared.count() * 8 <= BROADCAST_BYTES:
        known = np.sort(shared.select("key").toArrow().column("key").to_numpy())
    runs = covered_runs(strings(own, known, hot), parts)
    if hot:
        runs = runs.union(hot_runs(own, hot))
    runs = runs.union(copies.select("doc", "mark", F.lit(0).cast("long"), F.lit(WHOLE)))
    cuts = freeze(runs.groupBy("doc", "mark").agg(_joined(F.collect_list(F.struct("at", "n"))).alias("runs")))
    width = cuts.agg(F.sum(F.size("runs") * 16 + 48)).first()[0] or 0
    joined = rows.join(F.broadcast(cuts) if width <= BROADCAST_BYTES else cuts, ["doc", "mark"], "left")
    return _cut(joined.select("doc_id", "text", "runs"))


def _cut(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        for batch in batches:
            docs, texts, runs = batch.columns
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                raw = texts[i].as_py().encode()
                n, found, spans = len(raw), runs[i].as_py() or (), []
                for r in sorted(found, key=lambda r: r["at"]) if n >= WINDOW else ():
                    start, end = r["at"], min(n, r["at"] + r["n"] + WINDOW - 1)
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([start, end])
                digest, at = hashlib.sha256(), 0
                for start, end in spans:
                    digest.update(raw[at:start])
                    at = end
                digest.update(raw[at:])
                gone = sum(b - a for a, b in spans)
                row = (docs[i].as_py(), n, gone, len(spans), digest.hexdigest(), [{"start": a, "length": b - a} for a, b in spans])
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:bigint,length:bigint>>"
    )
    return rows.mapInArrow(cut, schema)


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark, folder):
    return suffix_dedup(table(spark, folder, "documents")).drop("spans")
