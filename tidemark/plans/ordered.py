"""Ordered computations over data of any size.

Spark evaluates an ordered window inside one task per window partition, so a
single long series (or one hot key) would land in one task.  Here the data is
range-partitioned into blocks of even size, each block is processed on its own,
and only one small row per block and key is combined across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.joining import null_safe_join
from tidemark.plans.storage import freeze

_BLOCK = "__block"
HALO_BLOCK_ROWS = 100_000


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def blocks_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored ``df`` in range-partitioned blocks with their number ``__block``; rows of equal keys and order share one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *_cols([*keys, *order]))
    return freeze(ranged.withColumn(_BLOCK, F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add exclusive running sums per key in ``order``.

    ``sums`` maps an output column to the summed column; ``totals`` maps an
    output column to a column summed over the whole key.  ``order`` must be
    unique within a key, so that a block boundary can fall between any two rows.
    """
    totals = dict(totals or {})
    blocked = blocks_in_order(df, keys, order)
    needed = sorted({*sums.values(), *totals.values()})
    per_block = blocked.groupBy(*_cols([*keys, _BLOCK])).agg(
        *[F.sum(f"`{c}`").alias(f"__s_{c}") for c in needed]
    )
    whole = W.partitionBy(*_cols(keys)) if keys else W.partitionBy(F.lit(0))
    earlier = whole.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *_cols([*keys, _BLOCK]),
        *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__o_{out}") for out, c in sums.items()],
        *[F.sum(f"__s_{c}").over(whole).alias(out) for out, c in totals.items()],
    )
    inside = (
        W.partitionBy(*_cols([*keys, _BLOCK])).orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, -1)
    )
    local = blocked.withColumns(
        {f"__l_{out}": F.coalesce(F.sum(f"`{c}`").over(inside), F.lit(0)) for out, c in sums.items()}
    )
    joined = null_safe_join(local, offsets, [*keys, _BLOCK])
    return joined.select(
        *_cols(df.columns),
        *[(F.col(f"__o_{out}") + F.col(f"__l_{out}")).alias(out) for out in sums],
        *_cols(list(totals)),
    )


def minimum_from_here(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the smallest ``value`` from each row to the end of its key, in ``order``, which is unique within a key.

    A block takes over the smallest value of the blocks after it.
    """
    blocked = blocks_in_order(df, keys, order)
    per_block = blocked.groupBy(*_cols([*keys, _BLOCK])).agg(F.min(f"`{value}`").alias("__least"))
    whole = W.partitionBy(*_cols(keys)) if keys else W.partitionBy(F.lit(0))
    later = whole.orderBy(F.desc(_BLOCK)).rowsBetween(W.unboundedPreceding, -1)
    carried = per_block.select(*_cols([*keys, _BLOCK]), F.min("__least").over(later).alias("__later"))
    backward = [c.desc() for c in _cols(order)]
    inside = W.partitionBy(*_cols([*keys, _BLOCK])).orderBy(*backward).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocked.withColumn("__here", F.min(f"`{value}`").over(inside))
    joined = null_safe_join(local, carried, [*keys, _BLOCK])
    return joined.select(*_cols(df.columns), F.least("__here", "__later").alias(out))


def with_position(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), pos: str = "pos", size: str = "n"
) -> DataFrame:
    """Number the rows of each series 0, 1, 2 … and add the series length."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return prefix_sums(one, keys, order, {pos: "__one"}, {size: "__one"}).drop("__one")


def halo_window(
    positioned: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    outputs: Callable[[W], Mapping[str, Column]],
    pos: str = "pos",
    size: str = "n",
    block_rows: int = HALO_BLOCK_ROWS,
) -> DataFrame:
    """Apply frame functions that reach ``before`` rows back and ``after`` ahead.

    Rows are cut into blocks by position and the rows near an edge are copied
    into the neighbouring block, so each block holds every row its frames need.
    ``outputs`` receives the ordered window of one block.
    """
    step = max(block_rows, before + after, 1)
    last = F.floor((F.col(size) - 1) / step)
    own = F.floor(F.col(pos) / step)
    first_needed = F.greatest(F.floor((F.col(pos) - after) / step), F.lit(0))
    last_needed = F.least(F.floor((F.col(pos) + before) / step), last)
    copied = positioned.withColumn("__own", own).withColumn(
        _BLOCK, F.explode(F.sequence(first_needed, last_needed))
    )
    window = W.partitionBy(*_cols([*keys, _BLOCK])).orderBy(pos)
    return (
        copied.withColumns(dict(outputs(window))).where(F.col("__own") == F.col(_BLOCK)).drop("__own", _BLOCK)
    )


def rolling(
    positioned: DataFrame,
    keys: Sequence[str],
    value: str,
    window: Column | int,
    centred: bool,
    mean: str = "rolling_mean",
    std: str = "rolling_std",
    max_window: int = 30,
    extra: Callable[[W], Mapping[str, Column]] | None = None,
    reach: int = 0,
) -> DataFrame:
    """Rolling mean and sample deviation over full windows only.

    ``window`` is a size shared by all series, or a column with the size of each
    series (at most ``max_window``): then the widest frame is gathered and the
    part a row needs is cut out of it.
    """
    if isinstance(window, int):
        ahead = (window - 1) // 2 if centred else 0
        behind = window - 1 - ahead

        def frame(block: W) -> dict[str, Column]:
            rows = block.rowsBetween(-behind, ahead)
            full = F.count(f"`{value}`").over(rows) == window
            return {
                mean: F.when(full, F.avg(f"`{value}`").over(rows)),
                std: F.when(full, F.stddev_samp(f"`{value}`").over(rows)),
                **(extra(block) if extra else {}),
            }

        return halo_window(positioned, keys, max(behind, reach), ahead, frame)

    most_ahead = (max_window - 1) // 2 if centred else 0
    most_behind = max_window - 1 - (0 if centred else most_ahead)
    ahead = F.floor((window - 1) / 2) if centred else F.lit(0)
    behind = window - 1 - ahead

    def gather(block: W) -> dict[str, Column]:
        rows = block.rowsBetween(-most_behind, most_ahead)
        packed = F.collect_list(F.struct("pos", F.col(f"`{value}`").cast("double").alias("v"))).over(rows)
        return {"__frame": packed, **(extra(block) if extra else {})}

    framed = halo_window(positioned, keys, max(most_behind, reach), most_ahead, gather)
    kept = F.filter(
        "__frame",
        lambda r: (r["pos"] >= F.col("pos") - behind) & (r["pos"] <= F.col("pos") + ahead) & r["v"].isNotNull(),
    )
    full = F.size("__values") == window
    total = F.aggregate("__values", F.lit(0.0), lambda acc, v: acc + v)
    spread = F.aggregate("__values", F.lit(0.0), lambda acc, v: acc + (v - F.col(mean)) * (v - F.col(mean)))
    return (
        framed.withColumn("__values", F.transform(kept, lambda r: r["v"]))
        .withColumn(mean, F.when(full, total / window))
        .withColumn(std, F.when(full & (window > 1), F.sqrt(spread / F.nullif(window - 1, F.lit(0)))))
        .drop("__frame", "__values")
    )


def forward_fill(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Replace nulls by the last earlier value of the series.

    A fill can reach back any distance, so each block hands its last known value
    on to the later ones instead of copying rows.
    """
    blocked = blocks_in_order(df, keys, order)
    when_set = {c: F.when(F.col(f"`{c}`").isNotNull(), F.struct(*_cols(order))) for c in columns}
    tails = blocked.groupBy(*_cols([*keys, _BLOCK])).agg(
        *[F.max_by(F.col(f"`{c}`"), when_set[c]).alias(f"__t_{c}") for c in columns]
    )
    whole = W.partitionBy(*_cols(keys)) if keys else W.partitionBy(F.lit(0))
    earlier = whole.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(
        *_cols([*keys, _BLOCK]),
        *[F.last(f"__t_{c}", ignorenulls=True).over(earlier).alias(f"__c_{c}") for c in columns],
    )
    inside = W.partitionBy(*_cols([*keys, _BLOCK])).orderBy(*_cols(order))
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = null_safe_join(blocked, carried, [*keys, _BLOCK]).withColumns(
        {c: F.coalesce(F.last(f"`{c}`", ignorenulls=True).over(upto), F.col(f"__c_{c}")) for c in columns}
    )
    return filled.select(*_cols(df.columns))
