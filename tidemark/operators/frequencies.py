"""Frequencies of text values without shuffling long texts.

A value of up to ``HEAD`` characters stands for itself.  A longer one travels as its
first characters and its SHA-256 digest, so a shuffle carries about a hundred bytes
for each distinct value, however long it is.  Heads sort as the values do, which
leaves only those that tie with the chosen one to be looked up in the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.storage import freeze

HEAD = 64


def digest(value: Column) -> Column:
    """The digest of a long text, null for one that its head holds whole."""
    return F.when(F.length(value) > HEAD, F.unhex(F.sha2(value.cast("binary"), 256)))


def short_key(value: Column) -> Column:
    """A text's bytes, or the digest of a long one: equal exactly where the texts are."""
    return F.coalesce(digest(value), value.cast("binary"))


def _long(df: DataFrame, columns: Sequence[str], whole: bool) -> DataFrame:
    """(column, head, digest) of every value, with the value itself if ``whole``."""

    def parts(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        value = [v.alias("value")] if whole else []
        return F.struct(F.lit(c).alias("column"), F.substring(v, 1, HEAD).alias("head"), digest(v).alias("digest"), *value)

    return df.select(F.inline(F.array(*map(parts, columns)))).where("head is not null")


def text_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, head, digest, count), one row per distinct value; nulls are left out."""
    return _long(df, columns, whole=False).groupBy("column", "head", "digest").count()


def with_values(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stored rows of ``text_frequencies`` with their ``value``; long ones are read from ``df``.

    All rows of a digest must hold one text: the smallest and largest are compared.
    """
    wanted = chosen.where("digest is not null").select("column", "digest").distinct()
    columns = [r["column"] for r in wanted.select("column").distinct().collect()]  # names of columns of df
    if not columns:
        return chosen.withColumn("value", F.col("head"))
    texts = attach(_long(df, columns, whole=True).where("digest is not null"), wanted, ["column", "digest"])
    found = texts.groupBy("column", "digest").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("two texts share a digest")))
    found = found.select("column", "digest", same.alias("value"))
    return null_safe_join(chosen, found, ["column", "digest"], "left").withColumn(
        "value", F.when(F.col("digest").isNull(), F.col("head")).otherwise(F.col("value"))
    )


def most_frequent(df: DataFrame, frequencies: DataFrame, k: int = 1) -> DataFrame:
    """(column, rank, value, count) of the ``k`` most frequent values, ties by value.

    ``frequencies`` is stored.  By count and head a value ranks with those that have
    both in common; of these only the ones that can be among the first k are looked up.
    """
    # A rank filter over a window keeps its rows per task before the shuffle (group limit).
    by_head = F.rank().over(W.partitionBy("column").orderBy(F.desc("count"), "head"))
    near = freeze(frequencies.withColumn("__near", by_head).where(F.col("__near") <= k).drop("__near"))
    by_value = F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))
    ranked = with_values(df, near).withColumn("rank", by_value).where(F.col("rank") <= k)
    return ranked.select("column", "rank", "value", "count")


def least_frequent(df: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(column, value, count) of the least frequent value; of several the largest."""
    by_head = F.rank().over(W.partitionBy("column").orderBy("count", F.desc("head")))
    near = freeze(frequencies.withColumn("__near", by_head).where(F.col("__near") == 1).drop("__near"))
    return with_values(df, near).groupBy("column").agg(F.max("value").alias("value"), F.min("count").alias("count"))
