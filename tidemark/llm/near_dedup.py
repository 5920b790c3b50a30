r"""Near-duplicate detection by circulant MinHash.

A document's set is its distinct 5-word shingles, A-Z lower-cased.  A first
permutation scatters the shingles over a ring of 2^20 places; a second one labels
the places.  Coordinate k of the signature is the smallest label at the set's
places after the ring is shifted by k, so two permutations give all coordinates,
and the labels a shingle meets are one contiguous slice of the label table.

32 bands of four coordinates: a pair at similarity 0.75 shares none with a
probability of 5e-6.  Equal sets are one class from the start.  In a bucket every
class is compared with the smallest one, and while that links, with another one of
each bucket that still holds several components.  The classes of buckets left open
meet across components by an exact prefix filter, so no new
link between them is left out, classes already joined are not paired again, and a
passage that many documents share pairs none of them.  A bitmap of each set rules out
most candidates that are not similar enough: every bit that two bitmaps do not share
stands for a shingle that the sets do not share, so none that is similar is lost.  Every
candidate left is confirmed on the whole sets, by integers: 100 * intersection >= 75 * union.

Shingles are compared by 64-bit hashes of their five word hashes.

Defined results: a document without words has an empty set and is linked with
nothing; one with fewer than five words has its word sequence as its only shingle;
rows with the same id are one document each and share a class id only if linked
or equal in id; rows without an id have no component and are kept; further
columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_BYTES, freeze, keep_rows, prepare, query, table, whole_text
from tidemark.operators.components import connected_components, smaller_nodes

SHINGLE = 5
RING = 1 << 20
# How many word hashes a Python worker remembers before it starts anew.
WORDS_KEPT = 100_000
# Stars are tried again while more than one in so many of their pairs links; what they leave meets by the prefix filter.
STAR_SHARE = 10
BANDS = 32
ROWS = 4
# 64-bit words of a set's bitmap.  Sets of far more shingles than bits are not ruled out by it, only confirmed.
BITMAP_WORDS = 16
ODD = np.uint64(0x9E3779B97F4A7C15)

_WORD_HASHES: dict[bytes, int] = {}
_LABELS: dict[tuple[int, int], np.ndarray] = {}


def labels(seed: int, length: int) -> np.ndarray:
    """Row p holds the labels at places p, p + 1, ..., p + length - 1 of the ring, as a view."""
    if (seed, length) not in _LABELS:
        ring = np.random.Generator(np.random.PCG64(seed)).permutation(RING).astype(np.uint32)
        wrapped = np.concatenate([ring, ring[: length - 1]])
        _LABELS[seed, length] = np.lib.stride_tricks.sliding_window_view(wrapped, length)
    return _LABELS[seed, length]


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORD_HASHES) > WORDS_KEPT:
        _WORD_HASHES.clear()
    for w in set(words).difference(_WORD_HASHES):
        _WORD_HASHES[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        out = h[: len(h) - width + 1] + np.uint64(width)
        for j in range(1, width):
            out = ((out ^ (out >> np.uint64(29))) * ODD) + h[j : len(h) - width + 1 + j]
        out = (out ^ (out >> np.uint64(32))) * ODD
    return np.unique(out ^ (out >> np.uint64(29)))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: the place on the ring of each shingle."""
    with np.errstate(over="ignore"):
        mixed = (shingles ^ (shingles >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(44)).astype(np.int64)


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> np.ndarray:
    """bands * rows coordinates of a non-empty set."""
    table_ = labels(seed, bands * rows)
    places = scatter(shingles)
    out = table_[places[:4096]].min(axis=0)
    for at in range(4096, len(places), 4096):
        np.minimum(out, table_[places[at : at + 4096]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of each signature."""
    grouped = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD, grouped.shape[:2]).copy()
        for j in range(rows):
            key = (key ^ (key >> np.uint64(29))) * ODD + grouped[:, :, j]
        key = (key ^ (key >> np.uint64(32))) * ODD
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for each value that the leading bits of the shingles' hashes take."""
    flags = np.zeros(64 * BITMAP_WORDS, dtype=np.uint8)
    flags[(shingles >> np.uint64(32)) % np.uint64(len(flags))] = 1
    return np.packbits(flags).view(np.int64)


def sketches(rows: DataFrame, bands: int = BANDS, rows_: int = ROWS) -> DataFrame:
    """(row, size, low, high, bands, bits) of (row, text): set size, a 128-bit hash of the set, band keys, bitmap."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low, high, signs, maps = [], [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py())
                both = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                low.append((both & ((1 << 64) - 1)) - (1 << 63))
                high.append((both >> 64) - (1 << 63))
                maps.append(bitmap(found))
                if len(found):
                    signs.append(signature(found, bands, rows_))
            keys = band_keys(np.stack(signs), bands, rows_) if signs else np.empty((0, bands), dtype=np.int64)
            ends = np.cumsum([0] + [bands * (n > 0) for n in sizes])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))
            words = np.concatenate(maps) if maps else np.empty(0, dtype=np.int64)
            bits = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1) * BITMAP_WORDS, pa.int32()), pa.array(words)
            )
            columns = [pa.array(c, pa.int64()) for c in (sizes, low, high)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, lists, bits], names=["row", "size", "low", "high", "bands", "bits"]
            )

    return rows.mapInArrow(
        sketch, "row long, size long, low long, high long, bands array<long>, bits array<long>"
    )


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(row, shingles) of (row, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(f) for f in found]), pa.int32()), pa.array(np.concatenate(found))
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", "shingles"])

    return rows.mapInArrow(sets, "row long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with what else they hold, whose sets are similar enough."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("__a"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("__b"))
    both = F.size(F.array_intersect("__a", "__b")).cast("long")
    union = F.size("__a") + F.size("__b") - both
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * union).select(pairs.columns)


def _could(percent: int) -> Column:
    """Whether sets of sizes ``size_a``, ``size_b`` and bitmaps ``bits_a``, ``bits_b`` can be similar enough at all."""
    a, b = F.col("size_a"), F.col("size_b")
    apart = [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITMAP_WORDS)]
    # at most (a + b - apart) / 2 shingles in common, of which percent / (100 + percent) of a + b are needed
    reach = (100 + percent) * (a + b - reduce(lambda x, y: x + y, apart)) >= 2 * percent * (a + b)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & reach


def possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes, with what else they hold, that sizes and bitmaps do not rule out."""
    left, right = (
        marks.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))
        for x in "ab"
    )
    return pairs.join(right, "b").join(left, "a").where(_could(percent)).select(pairs.columns)


def pairs_across(placed: DataFrame, sets: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components (lo, hi) that could be similar enough.

    An exact prefix filter.  Such a pair shares at least percent of the shingles of
    either side, and none that lies in one component only.  So a class needs that
    many shingles that lie in several components, and with these in order from the
    rarest on, the pair must share one among the first k - needed + 1 of both.
    Shingles that many components share stand last and bring no pairs together.
    Where many do meet, sizes and bitmaps let through those that may be similar.
    """
    ours = sets.join(placed, sets["row"] == placed["class"])
    one = ours.select("class", F.explode("shingles").alias("s"))
    spread = ours.select("component", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    common = one.join(spread.where("lo < hi").select("s", "n"), "s")
    # a class's own shingles, from the rarest on
    ranked = common.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("common"))
    sized = ranked.join(placed, "class").join(marks, "class").withColumns(
        {"k": F.size("common"), "needed": F.ceil(F.col("size") * percent / 100).cast("int")}
    )
    first = sized.where("k >= needed").select(
        "class", "component", "size", "bits", "k", F.posexplode(F.slice("common", 1, F.expr("k - needed + 1")))
    )
    first = freeze(
        first.select("class", "component", "size", "bits", F.col("col.s").alias("s"), (F.col("k") - F.col("pos")).alias("rest"))
    )
    left, right = (first.select("s", *[F.col(c).alias(f"{c}_{x}") for c in first.columns if c != "s"]) for x in "ab")
    # at the first shingle that a pair shares, what is left of both must hold the whole intersection
    rest = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("size_a") + F.col("size_b"))
    met = left.join(right, "s").where((F.col("component_a") < F.col("component_b")) & rest & _could(percent))
    return met.select(
        F.least("class_a", "class_b").alias("a"),
        F.greatest("class_a", "class_b").alias("b"),
        F.col("component_a").alias("lo"),
        F.col("component_b").alias("hi"),
    ).distinct()


def joined_by(found: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, component) of ``found`` with ``links`` (lo, hi) between its components, each of which is a node."""
    moved = smaller_nodes(links.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("__to"))
    joined = found.join(moved, "component", "left")
    return joined.select("node", F.coalesce("__to", "component").alias("component"))


def similar_classes(rows: DataFrame, percent: int = 75, bands: int = BANDS, rows_: int = ROWS) -> DataFrame:
    """(row, size, component) of (row, text) with distinct rows; empty sets are components of their own."""
    sketch = freeze(sketches(rows, bands, rows_))
    filled = sketch.where("size > 0")
    classes = freeze(
        filled.groupBy("size", "low", "high").agg(F.min("row").alias("class"), F.min_by(F.struct("bands", "bits"), "row").alias("of"))
    )
    marks = classes.select("class", "size", "of.bits")
    keyed = freeze(classes.select("class", "size", F.explode("of.bands").alias("key")))
    buckets = keyed.groupBy("key").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = freeze(keyed.join(buckets, "key"))
    stars = freeze(possible(shared.where("a != class").select("a", F.col("class").alias("b")).distinct(), marks, percent))

    # sets of the classes that share a bucket with another
    needed = shared.select(F.col("class").alias("row")).distinct()
    few = freeze(needed)
    if few.count() * 16 <= BROADCAST_BYTES:
        few = F.broadcast(few)
    sets = freeze(shingle_sets(rows.join(few, "row", "left_semi")))

    links = freeze(confirm(stars, sets, percent))
    found = freeze(connected_components(classes.select(F.col("class").alias("node")), links))

    # buckets that still hold several components: another class of each takes the middle, as long as that links
    tried, turn = stars, 0
    while True:
        placed = shared.select("key", "class").join(found.withColumnRenamed("node", "class"), "class")
        mixed = placed.groupBy("key").agg(
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.min_by(F.struct("class", "component"), F.xxhash64("class", F.lit(turn))).alias("head"),
        )
        open_ = freeze(placed.join(mixed.where("lo < hi").select("key", "head"), "key"))
        rays = open_.where(F.col("component") != F.col("head.component"))
        rays = rays.select(
            F.least("class", "head.class").alias("a"),
            F.greatest("class", "head.class").alias("b"),
            F.least("component", "head.component").alias("lo"),
            F.greatest("component", "head.component").alias("hi"),
        )
        rays = freeze(possible(rays.distinct(), marks, percent).join(tried, ["a", "b"], "left_anti"))
        fresh = freeze(confirm(rays, sets, percent))
        tested, linked = rays.count(), fresh.count()
        tried = tried.union(rays.select("a", "b"))
        if linked:
            found = freeze(joined_by(found, fresh))
        turn += 1
        if linked * STAR_SHARE <= tested:
            break

    # what is left open meets across components
    placed = shared.select("key", "class").join(found.withColumnRenamed("node", "class"), "class")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_ = placed.join(mixed.select("key"), "key").select("class", "component").distinct()
    across = freeze(pairs_across(open_, sets, marks, percent).join(tried, ["a", "b"], "left_anti"))
    more = freeze(confirm(across, sets, percent))
    if not more.isEmpty():
        found = freeze(joined_by(found, more))

    of_class = classes.select("size", "low", "high", F.col("class").alias("node")).join(found, "node").drop("node")
    members = filled.join(of_class, ["size", "low", "high"]).select("row", "size", "component")
    return members.union(sketch.where("size = 0").select("row", "size", F.col("row").alias("component")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    prepare(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    odd = base.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() > 0
    if not odd:
        found = similar_classes(base.select(F.col("doc_id").alias("row"), "text"), percent)
        return found.select(
            F.col("row").alias("doc_id"),
            F.col("size").alias("n_shingles"),
            F.col("component").alias("component_id"),
            (F.col("row") == F.col("component")).alias("kept"),
        )
    # ids that repeat or are null: distinct texts stand for the rows, numbered by a hash of id and text
    numbered = base.withColumn("row", F.xxhash64("doc_id", "text"))
    texts = numbered.groupBy("row").agg(F.min("text").alias("text"))
    found = freeze(similar_classes(texts, percent))
    placed = freeze(numbered.select("doc_id", "row").join(found, "row"))
    # rows with one id reach each other, so their components are one
    same_id = placed.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("lo"))
    ties = placed.join(same_id, "doc_id").where("component != lo").select(F.col("lo").alias("a"), F.col("component").alias("b"))
    whole = connected_components(placed.select(F.col("component").alias("node")).distinct(), ties.distinct())
    joined = placed.join(whole.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component")
    lowest = joined.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    return joined.join(lowest, "whole").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays: that with the smallest id.  Rows without an id stay."""
    gone = near_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id"))
    return keep_rows(docs, id_col, gone, keep=False)


@query(
    "op8_minhash_near_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
          FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
    r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d JOIN c ON doc_id = x LEFT JOIN n USING (doc_id)
    """,
)
def op8_minhash_near_dedup(spark, folder):
    return near_dedup(table(spark, folder, "documents"))
