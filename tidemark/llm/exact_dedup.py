"""Exact dedup of incoming documents against immutable snapshots.

A snapshot is written once: its rows grouped by SHA-256 digest, and one static
binary-fuse filter per digest bucket.  An incoming batch is grouped by digest on
its own first, so copies inside the batch meet in a partial aggregation.  Its
distinct digests are screened by the filters of their buckets; only positives
join the snapshot's exact buckets.  Rows whose digest occurs more than once are
then compared byte for byte with the text of the row that stays; texts that
share a digest without being equal are grouped by the whole text instead.

Defined results: a null text counts as empty; empty texts are copies of each
other; of equal texts the row with the largest id stays, and null ids stay only
among themselves; a repeated row is returned as often as it comes; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import fuse
from tidemark.llm.common import broadcast_if_small, freeze, prepare, query, table, whole_text

# Expected distinct digests of a bucket; its keys and filter fit a task's memory.
BUCKET_KEYS = 100_000
LEAST_BUCKETS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _bucket(buckets: int) -> Column:
    return F.pmod("key", F.lit(buckets)).cast("int")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).withColumn(
        "key", F.xxhash64("sha")
    )


@dataclass
class Snapshot:
    """``groups``: (sha, keep_id, n, key, bucket); ``filters``: one binary-fuse filter per bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def build_snapshot(rows: DataFrame) -> Snapshot:
    """Group the (id, sha) rows of a snapshot and store a filter for each of its buckets."""
    prepare(rows.sparkSession)
    groups = freeze(_groups(rows))
    buckets = max(LEAST_BUCKETS, 1 << (groups.count() // BUCKET_KEYS).bit_length())
    groups = groups.withColumn("bucket", _bucket(buckets))

    def one(part: pa.Table) -> pa.Table:
        seed, segment, prints = fuse.build(part.column("key").to_numpy().view(np.uint64))
        number = part.column("bucket")[0].as_py()
        columns = {"bucket": pa.array([number], pa.int32()), "seed": [seed], "segment": [segment], "prints": [prints]}
        return pa.table(columns)

    filters = groups.select("bucket", "key").groupBy("bucket").applyInArrow(
        one, "bucket int, seed long, segment long, prints binary"
    )
    return Snapshot(groups, freeze(filters), buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Add ``maybe`` to the distinct digests of a batch: false only where the snapshot lacks the digest."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        maybe = np.zeros(left.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            row = right.to_pylist()[0]
            keys = left.column("key").to_numpy().view(np.uint64)
            maybe = fuse.contains(keys, row["seed"], row["segment"], row["prints"])
        return left.append_column("maybe", pa.array(maybe))

    keyed = batch.withColumn("bucket", _bucket(snapshot.buckets))
    schema = "sha string, keep_id long, n long, key long, bucket int, maybe boolean"
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(one, schema)


def merge(snapshots: list[Snapshot], batch: DataFrame) -> DataFrame:
    """(sha, keep_id, n) over all snapshots and the batch, one row per digest."""
    open_, found = _groups(batch), []
    for snapshot in snapshots:
        screened = freeze(screen(open_.select("sha", "keep_id", "n", "key"), snapshot))
        hits = screened.where("maybe").select(
            "bucket", "sha", F.col("keep_id").alias("__keep"), F.col("n").alias("__n")
        )
        found.append(
            snapshot.groups.join(hits, ["bucket", "sha"], "full_outer").select(
                "sha",
                F.greatest("keep_id", "__keep").alias("keep_id"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("n"),
            )
        )
        open_ = screened.where("not maybe")
    union = open_.select("sha", "keep_id", "n")
    for other in found:
        union = union.unionByName(other)
    if len(snapshots) < 2:
        return union
    # a digest may lie in several snapshots
    return union.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    in_snapshot: list[Column] | None = None,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``in_snapshot`` has one condition per snapshot, which pick rows in turn; all
    other rows are the incoming batch.  By default even ids are one snapshot.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("body"))
    rows = rows.withColumns({"sha": digest(F.col("body"))})
    if in_snapshot is None:
        in_snapshot = [F.coalesce(F.col("id") % 2 == 0, F.lit(False))]
    part = F.lit(-1)
    for i, condition in reversed(list(enumerate(in_snapshot))):
        part = F.when(condition, F.lit(i)).otherwise(part)
    ids = freeze(rows.select("id", "sha", part.alias("part")))
    snapshots = [build_snapshot(ids.where(F.col("part") == i)) for i in range(len(in_snapshot))]
    groups = freeze(merge(snapshots, ids.where("part = -1"))) if snapshots else freeze(_groups(ids))

    # byte check of every row whose digest is not its own
    shared = groups.where("n > 1").select("sha", "keep_id")
    members = rows.join(shared, "sha")
    stays = members.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("body").alias("__stays"))
    clash = freeze(members.join(stays, "sha").where("body != __stays").select("sha").distinct())
    plain = ids
    if not clash.isEmpty():
        plain = ids.join(clash, "sha", "left_anti")
    out = plain.join(groups, "sha").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    if plain is ids:
        return out
    twins = rows.join(clash, "sha", "left_semi")
    whole = twins.groupBy("body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return out.unionByName(
        twins.join(whole, "body").select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts: that with the largest id.

    Of repeated rows with the same id and text one stays; rows without an id
    stay only where no equal text has one.
    """
    found = freeze(exact_dedup(docs, id_col, text_col))
    pair = ["doc_id", "text_sha256"]
    gone = found.where("not kept").select(*pair).distinct()
    again = freeze(found.where("kept").groupBy(*pair).count().where("count > 1").select(*pair))
    body = sha256(whole_text(text_col))

    def listed(stored: DataFrame, how: str) -> DataFrame:
        small = broadcast_if_small(stored.withColumnsRenamed({c: f"__{c}" for c in pair}), 100)
        on = docs[id_col].eqNullSafe(small["__doc_id"]) & (body == small["__text_sha256"])
        return docs.join(small, on, how)

    once = listed(freeze(gone.union(again)), "left_anti")
    if again.isEmpty():
        return once
    return once.unionByName(listed(again, "left_semi").dropDuplicates([id_col, text_col]))


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM d JOIN g USING (body)
    """,
)
def op9_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))
