"""A tree of boxes over points, and the pairs of its leaves that may hold what is looked for.

Points are split along the widest side of their box, at quantiles and at its middle,
until a leaf holds few of them: however many share a slab, no leaf grows with the
data.  A node is named by its path (``0.3.12``), so the boxes of every level follow
from those of the leaves.  Pairs are found from the root down: a pair of boxes that
cannot hold a match is left with all below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.joining import BROADCAST_BYTES
from tidemark.plans.storage import freeze

FANOUT = 16
ROOT = "0"


def _box(at: str, d: int) -> list[Column]:
    lo = F.array(*[F.min(F.col(at)[i]) for i in range(d)]).alias("lo")
    hi = F.array(*[F.max(F.col(at)[i]) for i in range(d)]).alias("hi")
    return [lo, hi]


def _small(stored: DataFrame, d: int) -> DataFrame:
    """Mark a stored table of nodes for broadcast if its size is small enough."""
    return F.broadcast(stored) if stored.count() * (200 + 32 * d) <= BROADCAST_BYTES else stored


def with_leaf(points: DataFrame, at: str, d: int, leaf_points: int, fanout: int = FANOUT) -> DataFrame:
    """``points`` with a column ``leaf``; ``at`` is an array of ``d`` numbers.

    A leaf has at most ``leaf_points`` rows, unless they all lie at one place.
    """
    if points.limit(leaf_points + 1).count() <= leaf_points:
        return points.withColumn("leaf", F.lit(ROOT))
    shares = F.array(*[F.lit(i / fanout) for i in range(1, fanout)])
    open_, done = points.withColumn("leaf", F.lit(ROOT)), None
    while True:
        boxes = open_.groupBy("leaf").agg(F.count(F.lit(1)).alias("__n"), *_box(at, d))
        sides = F.zip_with("hi", "lo", lambda h, low: h - low)
        axis = (F.array_position(sides, F.array_max(sides)) - 1).cast("int")
        crowded = (F.col("__n") > leaf_points) & (F.array_max(sides) > 0)
        nodes = boxes.withColumn("__axis", F.when(crowded, axis)).select(
            F.col("leaf").alias("__node"), "__axis", ((F.col("lo")[axis] + F.col("hi")[axis]) / 2).alias("__middle")
        )
        joined = open_.join(_small(freeze(nodes), d), F.col("leaf") == F.col("__node")).drop("__node")
        marked = freeze(joined.withColumn("__value", F.when(F.col("__axis").isNotNull(), F.col(at)[F.col("__axis")])))
        left = marked.where("__axis is null").drop("__axis", "__middle", "__value")
        done = left if done is None else done.union(left)
        rest = marked.where("__axis is not null")
        if rest.isEmpty():
            return done
        # the middle is a cut as well: where equal values fill all quantiles, it still parts them from the others
        cuts = rest.groupBy("leaf").agg(
            F.concat(
                F.percentile_approx(F.col("__value").cast("double"), shares, F.lit(1000)), F.array(F.first("__middle"))
            ).alias("__cuts")
        )
        cuts = freeze(cuts.select(F.col("leaf").alias("__node"), F.array_distinct("__cuts").alias("__cuts")))
        parted = rest.join(_small(cuts, fanout), F.col("leaf") == F.col("__node"))
        child = F.size(F.filter("__cuts", lambda c: F.col("__value") > c))
        open_ = freeze(
            parted.withColumn("leaf", F.concat_ws(".", "leaf", child.cast("string"))).select(*points.columns, "leaf")
        )


def leaf_boxes(leafed: DataFrame, at: str, d: int, **extra: Column) -> DataFrame:
    """(leaf, lo, hi) and further aggregates of each leaf."""
    return leafed.groupBy("leaf").agg(*_box(at, d), *[c.alias(n) for n, c in extra.items()])


def near_leaves(
    boxes: DataFrame, d: int, keep: Callable[[str, str], Column], merged: dict[str, Callable[[str], Column]] | None = None
) -> DataFrame:
    """Ordered pairs (leaf1, leaf2) of leaves, a leaf with itself included, that ``keep`` does not rule out.

    ``boxes`` has leaf, lo, hi and the columns of ``merged``, each with the aggregate that
    gives a parent's value.  ``keep("1", "2")`` judges the columns with these endings;
    what it rules out for two boxes must be ruled out for all boxes inside them.
    """
    merged = merged or {}
    stored = freeze(boxes)
    depth = stored.agg(F.max(F.size(F.split("leaf", r"\.")))).first()[0]
    pairs = stored.limit(1).select(F.lit(ROOT).alias("leaf1"), F.lit(ROOT).alias("leaf2"))
    for level in range(1, (depth or 0) + 1):
        node = F.substring_index("leaf", ".", level)
        above = F.substring_index("leaf", ".", max(level - 1, 1))
        here = stored.groupBy(node.alias("node"), above.alias("above")).agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(d)]).alias("lo"),
            F.array(*[F.max(F.col("hi")[i]) for i in range(d)]).alias("hi"),
            *[f(c).alias(c) for c, f in merged.items()],
        )
        here = _small(freeze(here), d)
        one, two = ([F.col(c).alias(f"{c}{end}") for c in here.columns] for end in "12")
        found = (
            pairs.join(here.select(*one), F.col("leaf1") == F.col("above1"))
            .join(here.select(*two), F.col("leaf2") == F.col("above2"))
            .where(keep("1", "2"))
        )
        pairs = freeze(found.select(F.col("node1").alias("leaf1"), F.col("node2").alias("leaf2")))
    return pairs


def box_gap(one: str, two: str, d: int, slack: float = 0.0) -> Column:
    """Squared distance of two boxes, each side's gap lessened by ``slack``."""
    total = F.lit(0.0)
    for i in range(d):
        over = F.col(f"lo{two}")[i] - F.col(f"hi{one}")[i]
        under = F.col(f"lo{one}")[i] - F.col(f"hi{two}")[i]
        gap = F.greatest(over - slack, under - slack, F.lit(0)).cast("double")
        total = total + gap * gap
    return total
