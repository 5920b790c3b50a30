"""Clustering: preparation, k-means with choice of k, and validation of any labelling.

K-means grows its clusterings: the one into k+1 clusters starts from that into k, so all
candidates share one stored table of points and none is fitted anew.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import as_double, require_columns
from tidemark.operators.derive import choose_features
from tidemark.plans.boxtree import box_gap, leaf_boxes, near_leaves, with_leaf
from tidemark.plans.joining import attach, null_safe_join
from tidemark.plans.quantiles import SMALL_VALUES, quantiles
from tidemark.plans.storage import freeze

MAX_ITERATIONS = 100
TOLERANCE = 1e-3
CANDIDATE_K = range(2, 11)
LARGEST_K = 6
MIN_ROWS = 10
NOISE = -1
# Centres are compared in leaves of at most so many.
LEAF_CENTRES = 256


class Cluster(NamedTuple):
    """Rows of a cluster, their mean, and per feature the sum of squares about it."""

    size: int
    mean: list[float]
    squares: list[float]


def scaled_name(feature: str) -> str:
    return f"scaled_{feature}"


def prepare_features(df: DataFrame, features: Sequence[str] | None = None, small_values: int = SMALL_VALUES) -> DataFrame:
    """Complete rows with their features clipped to q01-q99, plus robustly scaled copies."""
    features = choose_features(df) if features is None else list(features)
    require_columns(df, features)
    if len(features) < 2:
        raise ValueError("need at least two numeric features")
    numbers = df.withColumns({f: as_double(df, f) for f in features}).dropna(subset=features)
    if numbers.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} complete rows")
    # Clipping the outer percents leaves the quartiles where they are, so one pass
    # gives the limits and the scale.
    points = {"low": 0.01, "q1": 0.25, "q2": 0.5, "q3": 0.75, "high": 0.99}
    found = {r["column"]: r for r in quantiles(numbers, features, points, small_values=small_values).collect()}

    def clipped(f: str) -> Column:
        return F.least(F.greatest(F.col(f"`{f}`"), F.lit(found[f]["low"])), F.lit(found[f]["high"]))

    def scaled(f: str) -> Column:
        return (F.col(f"`{f}`") - F.lit(found[f]["q2"])) / F.lit((found[f]["q3"] - found[f]["q1"]) or 1.0)

    return numbers.withColumns({f: clipped(f) for f in features}).withColumns(
        {scaled_name(f): scaled(f) for f in features}
    )


def _distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    return _squares(columns, [F.lit(float(x)) for x in centre])


def nearest(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre; the first of equally near ones."""
    numbered = [
        F.struct(_distance(columns, c).alias("far"), F.lit(j).alias("j")) for j, c in enumerate(centres)
    ]
    return F.least(*numbered)["j"] if len(numbered) > 1 else F.lit(0)


def assign_and_describe(points: DataFrame, centres: Sequence[Sequence[float]]) -> list[Cluster]:
    """One pass: rows go to their nearest centre; size, means and sums of squares of what came together.

    A centre that no row is nearest to stays where it is.  The driver gets a row per centre.
    """
    columns = points.columns
    found = {
        r["j"]: r
        for r in points.withColumn("j", nearest(columns, centres))
        .groupBy("j")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
        )
        .collect()
    }
    dims = range(len(columns))
    return [
        Cluster(r["n"], [r[f"m{i}"] for i in dims], [r[f"v{i}"] * r["n"] for i in dims])
        if (r := found.get(j))
        else Cluster(0, list(centre), [0.0 for _ in dims])
        for j, centre in enumerate(centres)
    ]


def split_costliest(clusters: Sequence[Cluster]) -> list[list[float]] | None:
    """Centres with the costliest cluster's cut in two, a deviation apart from its mean in its widest feature.

    None if no cluster has any spread: there are no more distinct points than centres.
    """
    costs = [sum(c.squares) for c in clusters]
    at = costs.index(max(costs))
    if costs[at] <= 0:
        return None
    widest = clusters[at].squares.index(max(clusters[at].squares))
    reach = math.sqrt(clusters[at].squares[widest] / clusters[at].size)
    centres = [list(c.mean) for c in clusters]
    low, high = list(centres[at]), list(centres[at])
    low[widest] -= reach
    high[widest] += reach
    centres[at] = low
    return [*centres, high]


def grow(points: DataFrame, k: int) -> list[list[Cluster]]:
    """Clusterings into 1, 2, ... ``k`` clusters, each grown from the one before in two passes.

    The costliest cluster is split, rows are assigned to the new centres, and once more to
    the means.  Nothing is drawn at random.  Fewer are returned where the distinct points are fewer.
    """
    start = points.agg(*[F.avg(c) for c in points.columns]).first()
    grown = [assign_and_describe(points, [list(start)])]
    while len(grown) < k and (centres := split_costliest(grown[-1])) is not None:
        moved = assign_and_describe(points, centres)
        grown.append(assign_and_describe(points, [c.mean for c in moved]))
    return grown


def settle(points: DataFrame, clusters: Sequence[Cluster]) -> list[list[float]]:
    """Centres after assigning and averaging until none moves further than ``TOLERANCE``, in ascending order."""
    centres = [list(c.mean) for c in clusters]
    for _ in range(MAX_ITERATIONS):
        means = [c.mean for c in assign_and_describe(points, centres)]
        moved = max(math.dist(a, b) for a, b in zip(centres, means))
        centres = means
        if moved <= TOLERANCE:
            break
    return sorted(centres)


def elbow(costs: Sequence[float], first_k: int = 2, largest: int = LARGEST_K) -> int:
    """The k after which the gain of one more cluster drops most, at most ``largest``."""
    gains = [a - b for a, b in zip(costs, costs[1:])]
    drops = [a - b for a, b in zip(gains, gains[1:])]
    if not drops or max(drops) <= 0:
        return first_k
    return min(first_k + 1 + drops.index(max(drops)), largest)


def kmeans(
    df: DataFrame,
    features: Sequence[str] | None = None,
    k: int | None = None,
    small_values: int = SMALL_VALUES,
    largest: int = LARGEST_K,
    candidates: Sequence[int] = CANDIDATE_K,
) -> DataFrame:
    """Complete rows with a ``cluster`` column (0 ... k-1), clipped and scaled features.

    Without ``k``, the elbow of the costs of ``candidates`` (consecutive numbers) decides, at
    most ``largest``; all of them come from one growing row of clusterings.  Clusters are
    numbered by their centres.  With fewer distinct points than ``k`` there are fewer clusters.
    """
    features = choose_features(df) if features is None else list(features)
    prepared = freeze(prepare_features(df, features, small_values))
    columns = [scaled_name(f) for f in features]
    points = prepared.select(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]).persist()
    try:
        grown = grow(points, max(candidates) if k is None else k)
        if k is None:
            costs = [sum(sum(c.squares) for c in clusters) for clusters in grown[min(candidates) - 1 :]]
            k = elbow(costs, min(candidates), largest)
        centres = settle(points, grown[min(k, len(grown)) - 1])
    finally:
        points.unpersist()
    return prepared.withColumn("cluster", nearest(columns, centres))


def cluster_profile(labelled: DataFrame, features: Sequence[str], small_values: int = SMALL_VALUES) -> DataFrame:
    """Size and share of each cluster with mean, median, deviation and extremes per feature."""
    total = labelled.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    pairs = F.array(*[F.struct(F.lit(f).alias("column"), as_double(labelled, f).alias("value")) for f in features])
    stats = (
        labelled.select("cluster", F.inline(pairs))
        .groupBy("cluster", "column")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .withColumn("percentage", F.col("size") / F.lit(max(total, 1)) * 100)
    )
    medians = quantiles(labelled, features, {"median": 0.5}, ["cluster"], small_values=small_values)
    name = F.when(F.col("cluster") == NOISE, "noise").otherwise(F.concat(F.lit("cluster_"), F.col("cluster")))
    return null_safe_join(stats, medians, ["cluster", "column"]).withColumn("cluster_name", name)


def _squares(columns: Sequence[str], other: Sequence[Column]) -> Column:
    return reduce(
        lambda a, b: a + b, [(F.col(f"`{c}`") - o) * (F.col(f"`{c}`") - o) for c, o in zip(columns, other)]
    )


def worst_ratios(centres: DataFrame, d: int) -> DataFrame:
    """(cluster, worst): the largest (s + s') / distance of a centre to any other.

    ``centres`` has a cluster, ``m0`` ... and the spread ``s``.  Centres meet in the leaves
    of a tree; what a leaf's own centres reach rules out leaves too far away to exceed
    it.  Centres at one place give infinity.
    """
    at = F.array(*[F.col(f"m{i}") for i in range(d)])
    leafed = freeze(with_leaf(centres.select("cluster", "s", at.alias("at")), "at", d, LEAF_CENTRES))

    def ratios(pairs: DataFrame | None) -> DataFrame:
        one, two = (leafed.select(*[F.col(c).alias(f"{c}{end}") for c in leafed.columns]) for end in "12")
        if pairs is None:
            met = one.join(two, (F.col("leaf1") == F.col("leaf2")) & (F.col("cluster1") != F.col("cluster2")))
        else:
            met = pairs.join(one, "leaf1").join(two, "leaf2").where("cluster1 <> cluster2")
        square = reduce(
            lambda a, b: a + b, [(F.col("at1")[i] - F.col("at2")[i]) * (F.col("at1")[i] - F.col("at2")[i]) for i in range(d)]
        )
        ratio = F.when(square > 0, (F.col("s1") + F.col("s2")) / F.sqrt(square)).otherwise(F.lit(float("inf")))
        return met.groupBy(F.col("cluster1").alias("cluster")).agg(F.max(ratio).alias("worst"))

    own = freeze(ratios(None))
    if leafed.where("leaf <> '0'").isEmpty():
        return own
    known = null_safe_join(leafed, own, ["cluster"], "left")
    boxes = leaf_boxes(known, "at", d, most=F.max("s"), least=F.min(F.coalesce("worst", F.lit(0.0))))

    def may_exceed(a: str, b: str) -> Column:
        reached = F.col(f"least{a}") * (1 - 1e-9)
        both = F.col(f"most{a}") + F.col(f"most{b}")
        gap = box_gap(a, b, d)
        return (gap == 0) | (both * both >= reached * reached * gap)

    return ratios(near_leaves(boxes, d, may_exceed, {"most": F.max, "least": F.min}))


def validate_clusters(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quality of a labelling on the scaled features, one row.

    The silhouette uses squared Euclidean distances, for which it follows from
    cluster sums in one pass.  Noise (-1) is left out of the silhouette; the
    Calinski-Harabasz and Davies-Bouldin indices are given only without noise.
    Centres stay a table, of any number of clusters.
    """
    columns = [scaled_name(f) for f in features]
    means = [f"m{i}" for i in range(len(columns))]
    counts = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") == NOISE).alias("noise")
    ).first()
    inside = labelled.where(F.col("cluster") != NOISE)
    centres = freeze(
        inside.groupBy("cluster").agg(
            F.count(F.lit(1)).alias("size"), *[F.avg(f"`{c}`").alias(m) for m, c in zip(means, columns)]
        )
    )
    sums = centres.agg(
        F.count(F.lit(1)).alias("k"), F.sum("size").alias("rows"), *[F.sum(F.col("size") * F.col(m)).alias(m) for m in means]
    ).first()
    k, n, rows = sums["k"], counts["n"], sums["rows"]
    out = {"n_samples": n, "n_features": len(features), "n_clusters": k, "n_noise": counts["noise"],
           "noise_ratio": counts["noise"] / n if n else 0.0}
    scores = {"silhouette_squared": None, "inertia": None, "calinski_harabasz": None, "davies_bouldin": None}
    if 1 < k < n:
        numbers = inside.select("cluster", *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
        placed = attach(numbers, centres, ["cluster"], stored=True)
        square = _squares([f"x{i}" for i in range(len(columns))], [F.col(m) for m in means])
        spread = placed.groupBy("cluster").agg(F.sum(square).alias("ss"), F.avg(F.sqrt(square)).alias("s"))
        described = freeze(null_safe_join(centres, spread, ["cluster"]))
        grand = [sums[m] / rows for m in means]
        between, within = described.agg(
            F.sum(F.col("size") * _squares(means, [F.lit(float(g)) for g in grand])), F.sum("ss")
        ).first()
        vectors = VectorAssembler(inputCols=columns, outputCol="vector").transform(inside)
        evaluator = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster")
        scores |= {"silhouette_squared": float(evaluator.evaluate(vectors)), "inertia": float(within)}
        if counts["noise"] == 0:
            worst = worst_ratios(described.select("cluster", "s", *means), len(columns))
            scores["davies_bouldin"] = worst.agg(F.sum("worst")).first()[0] / k
            scores["calinski_harabasz"] = (
                float(between / (k - 1) / (within / (rows - k))) if within and rows > k else None
            )
    schema = (
        "n_samples long, n_features int, n_clusters int, n_noise long, noise_ratio double, silhouette_squared double, "
        "inertia double, calinski_harabasz double, davies_bouldin double"
    )
    one = labelled.sparkSession.createDataFrame([tuple({**out, **scores}.values())], schema)
    s, db = F.col("silhouette_squared"), F.col("davies_bouldin")
    return one.withColumns(
        {
            "silhouette_interpretation": F.when(s > 0.7, "strong")
            .when(s > 0.5, "reasonable")
            .when(s > 0.25, "weak")
            .when(s.isNotNull(), "poor"),
            "davies_bouldin_interpretation": F.when(db < 1, "good").when(db < 2, "acceptable").when(db.isNotNull(), "poor"),
            "overall_quality": F.when(s > 0.5, "good").when(s > 0.25, "fair").when(s.isNotNull(), "poor"),
        }
    )
