"""DBSCAN on a grid, exact and without comparing all pairs of a crowded cell.

Cells are so small that two points of one cell are always neighbours.  A cell
holding ``min_samples`` rows is therefore all core points of one cluster, and only
points of thin cells are compared with the points of nearby cells.  With up to three
features nearby cells are looked up by their indices, with more by a tree of boxes
over the occupied cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.clustering import NOISE, prepare_features, scaled_name
from tidemark.operators.components import connected_components
from tidemark.operators.derive import choose_features
from tidemark.plans.boxtree import box_gap, leaf_boxes, near_leaves, with_leaf
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.ordered import with_position
from tidemark.plans.quantiles import SMALL_VALUES
from tidemark.plans.storage import freeze

# A crowded cell is split into chunks of about this many distinct points for joins.
CHUNK_POINTS = 10_000
# Two groups of points are compared directly up to this many pairs, else subdivided.
DIRECT_PAIRS = 10_000
# With more features than this, nearby cells are found by a tree instead of index offsets.
GRID_DIMENSIONS = 3
# A leaf of that tree holds at most so many occupied cells.
LEAF_CELLS = 64


def _xs(d: int, prefix: str = "x") -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _square(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda s, t: s + t, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)])


def _box_gap(a: str, b: str, d: int, side: float, nearest: bool) -> Column:
    """Squared smallest (or largest) distance of two grid boxes given by index arrays."""
    total = F.lit(0.0)
    for i in range(d):
        apart = F.abs(F.col(a)[i] - F.col(b)[i])
        steps = F.greatest(apart - 1, F.lit(0)) if nearest else apart + 1
        total = total + steps.cast("double") * steps * side * side
    return total


def _grid(names: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(F.col(n) / side) for n in names])


def _cells_by_offset(cells: DataFrame, d: int) -> DataFrame:
    """Pairs of occupied cells, one looked up by each index offset within reach of the other."""
    reach = int(math.isqrt(d)) + 1
    offsets = [
        o
        for o in itertools.product(range(-reach, reach + 1), repeat=d)
        if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d
    ]
    shift = F.explode(F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in offsets]))
    near_key = F.zip_with("cell1", "shift", lambda c, o: c + o)
    left = cells.select(F.col("cid").alias("cid1"), F.col("cell").alias("cell1")).withColumn("shift", shift)
    right = cells.select(F.col("cid").alias("cid2"), F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"))
    return left.withColumn("key", near_key).join(right, F.col("key") == F.col("cell2"))


def _cells_by_tree(cells: DataFrame, d: int, side: float, slack: float) -> DataFrame:
    """Pairs of occupied cells from leaves of a tree that lie near each other.

    Leaves are of bounded size and both sides of a pair are keyed by leaf, so neither a
    slab with most of the cells nor the number of features makes a key crowded.
    """
    leafed = freeze(with_leaf(cells.select("cid", "cell", "chunks"), "cell", d, LEAF_CELLS))
    pairs = near_leaves(
        leaf_boxes(leafed, "cell", d), d, lambda a, b: box_gap(a, b, d, slack=1) * F.lit(side * side) <= slack
    )
    left = leafed.select(F.col("leaf").alias("leaf1"), F.col("cid").alias("cid1"), F.col("cell").alias("cell1"))
    right = leafed.select(
        F.col("leaf").alias("leaf2"), F.col("cid").alias("cid2"), F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2")
    )
    return pairs.join(left, "leaf1").join(right, "leaf2")


def _neighbour_cells(cells: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Pairs of occupied cells (cid1, cid2, chunks2) that may hold points within ``eps``."""
    slack = eps * eps * (1 + 1e-9)
    pairs = _cells_by_offset(cells, d) if d <= GRID_DIMENSIONS else _cells_by_tree(cells, d, side, slack)
    return pairs.where(_box_gap("cell1", "cell2", d, side, nearest=True) <= slack).select("cid1", "cid2", "chunks2")


def _within(probes: DataFrame, near: DataFrame, targets: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs (probe, target) within ``eps``; crowded target cells are spread over chunks."""
    x, y = _xs(d), _xs(d, "y")
    sent = probes.join(near, F.col("cid") == F.col("cid1")).withColumn(
        "chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1))
    )
    other = targets.withColumnsRenamed({**dict(zip(x, y)), "cid": "target_cid", "chunk": "target_chunk"})
    match = (
        (F.col("cid2") == F.col("target_cid"))
        & (F.col("chunk2") == F.col("target_chunk"))
        & (_square(x, y) <= F.lit(eps * eps))
    )
    return sent.join(other, match)


def _cell_links(core: DataFrame, near: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Pairs of cells (a, b) that join the same cells as all pairs with core points within ``eps`` of each other.

    Boxes of points are compared first by their extent and by one sample point
    each.  Cells that these links join already are not compared further; the other
    pairs are compared point by point if small, else both boxes are halved and the
    halves compared.
    """
    x, y = _xs(d), _xs(d, "y")
    has_core = core.select("cid").distinct()
    pairs = (
        near.where("cid1 < cid2")
        .join(has_core.withColumnRenamed("cid", "cid1"), "cid1", "left_semi")
        .join(has_core.withColumnRenamed("cid", "cid2"), "cid2", "left_semi")
        .select("cid1", "cid2")
    )
    nodes = freeze(has_core.select(F.col("cid").alias("node")))
    joined, open_pairs, level_side, points = None, pairs, side, core
    while True:
        points = points.withColumn("box", _grid(x, level_side))
        # the points of a box are summed up once; any of them serves as its sample
        parts = freeze(
            points.groupBy("cid", "box").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in x])
        ).withColumn("parent", F.transform("box", lambda v: F.floor(v / 2)))
        one, two = (parts.select(*[F.col(c).alias(f"{c}{end}") for c in ("cid", "box", "n", *x, "parent")]) for end in "12")
        if joined is None:
            compared = open_pairs.join(one, "cid1").join(two, "cid2")
        else:
            compared = open_pairs.join(one, ["cid1", "parent1"]).join(two, ["cid2", "parent2"])
        gap = _square([f"{c}1" for c in x], [f"{c}2" for c in x])
        judged = freeze(
            compared.withColumn(
                "hit", (gap <= eps * eps) | (_box_gap("box1", "box2", d, level_side, nearest=False) <= eps * eps * (1 - 1e-9))
            )
            .where(_box_gap("box1", "box2", d, level_side, nearest=True) <= eps * eps * (1 + 1e-9))
            .select("cid1", "cid2", "box1", "box2", "n1", "n2", "hit")
        )
        sure = judged.where("hit").select(F.col("cid1").alias("a"), F.col("cid2").alias("b")).distinct()
        label = freeze(connected_components(nodes, sure if joined is None else joined.union(sure)))
        joined = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
        undecided = judged.where("not hit")
        for end in "12":
            of = label.select(F.col("node").alias(f"cid{end}"), F.col("component").alias(f"component{end}"))
            undecided = attach(undecided, of, [f"cid{end}"], stored=True)
        undecided = freeze(undecided.where("component1 != component2").drop("component1", "component2"))
        small = undecided.where(F.col("n1") * F.col("n2") <= DIRECT_PAIRS)
        left = points.select(F.col("cid").alias("cid1"), F.col("box").alias("box1"), *x)
        right = points.select(F.col("cid").alias("cid2"), F.col("box").alias("box2"), *[F.col(a).alias(b) for a, b in zip(x, y)])
        direct = (
            small.select("cid1", "cid2", "box1", "box2")
            .join(left, ["cid1", "box1"])
            .join(right, ["cid2", "box2"])
            .where(_square(x, y) <= F.lit(eps * eps))
            .select("cid1", "cid2")
        )
        if undecided.isEmpty():
            return joined
        linked = freeze(direct.distinct())
        joined = joined.union(linked.select(F.col("cid1").alias("a"), F.col("cid2").alias("b")))
        open_pairs = freeze(
            undecided.where(F.col("n1") * F.col("n2") > DIRECT_PAIRS)
            .join(linked, ["cid1", "cid2"], "left_anti")
            .select("cid1", "cid2", F.col("box1").alias("parent1"), F.col("box2").alias("parent2"))
        )
        if open_pairs.isEmpty():
            return joined
        still = open_pairs.select(F.col("cid1").alias("cid")).union(open_pairs.select("cid2")).distinct()
        points = freeze(core.join(still, "cid", "left_semi"))
        level_side /= 2


def label_dense_regions(rows: DataFrame, columns: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """Rows with ``cluster`` (0, 1, …; -1 for noise) from DBSCAN over ``columns``.

    Equal points are merged first.  A border point next to several clusters joins
    the one with the smallest number.
    """
    d = len(columns)
    x = _xs(d)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    coordinates = rows.select(*[(F.col(f"`{c}`") + 0.0).alias(n) for c, n in zip(columns, x)])
    merged = coordinates.groupBy(*x).agg(F.count(F.lit(1)).alias("w")).withColumn("cell", _grid(x, side))
    cells = merged.groupBy("cell").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK_POINTS).cast("int")
    numbered = freeze(
        with_position(cells, ["cell"], pos="cid", size="__cells").select("cell", "cid", "weight", chunks.alias("chunks"))
    )
    points = freeze(
        attach(merged, numbered, ["cell"]).select(
            "cid", *x, "w", "weight", F.pmod(F.xxhash64(*x), F.col("chunks")).cast("int").alias("chunk")
        )
    )
    near = freeze(_neighbour_cells(numbered, d, side, eps))
    thin = points.where(F.col("weight") < min_samples)
    counted = (
        _within(thin.select("cid", *x), near, points.select("cid", *x, "chunk", F.col("w").alias("w2")), d, eps)
        .groupBy("cid", *x)
        .agg(F.sum("w2").alias("reach"))
    )
    judged = thin.join(counted, ["cid", *x])
    dense = points.where(F.col("weight") >= min_samples).select("cid", *x, "chunk")
    core = freeze(dense.union(judged.where(F.col("reach") >= min_samples).select("cid", *x, "chunk")))
    nodes = core.select(F.col("cid").alias("node")).distinct()
    component = connected_components(nodes, _cell_links(core, near, d, side, eps))
    order = with_position(component.select("component").distinct(), ["component"], pos="cluster", size="__k")
    cell_label = freeze(
        component.join(order, "component").select(F.col("node").alias("cid"), F.col("cluster").cast("int").alias("cluster"))
    )
    core_labels = attach(core, cell_label, ["cid"])
    rest = judged.where(F.col("reach") < min_samples).select("cid", *x)
    border = (
        _within(rest, near, core_labels.select("cid", *x, "chunk", "cluster"), d, eps)
        .groupBy(*x)
        .agg(F.min("cluster").alias("cluster"))
    )
    labels = core_labels.select(*x, "cluster").union(border.select(*x, "cluster"))
    keyed = rows.withColumns({n: F.col(f"`{c}`") + 0.0 for c, n in zip(columns, x)})
    joined = null_safe_join(keyed, labels, x, "left")
    return joined.withColumn("cluster", F.coalesce("cluster", F.lit(NOISE))).drop(*x)


def dbscan(
    df: DataFrame,
    features: Sequence[str] | None = None,
    eps: float = 0.5,
    min_samples: int | None = None,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """DBSCAN of the clipped and robustly scaled features; complete rows with ``cluster``."""
    features = choose_features(df) if features is None else list(features)
    prepared = freeze(prepare_features(df, features, small_values))
    needed = max(2, len(features)) if min_samples is None else min_samples
    return label_dense_regions(prepared, [scaled_name(f) for f in features], eps, needed)
