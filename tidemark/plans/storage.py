"""Cutting lineage through reliable storage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor reaches.

    Only a session on one machine (``local`` or ``local[...]``) that names none,
    as in tests, gets a temporary folder.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = sc.getCheckpointDir()
    if shared is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


# Shuffle files of a query go with its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Used where a column must not change if a task runs again (a partition
    number, say), and between rounds of an iterative operator.  What was shuffled
    for it goes at once, not when the driver next collects its garbage: a loop of
    many small rounds would fill the disk with files.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        own = df.select("*")  # a plan of its own: the caller's keeps its shuffles
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return own.checkpoint()
