"""Isolation forest: trees from bounded samples, all rows scored in place."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.types import as_double
from tidemark.operators.sampling import bounded_sample, key_hash
from tidemark.plans.shipping import ship_package
from tidemark.plans.quantiles import SMALL_VALUES, scalar_quantiles
from tidemark.plans.storage import freeze

TREES = 100
SAMPLE = 256
EULER_GAMMA = 0.5772156649015329


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth); a leaf has feature -1 and its path length."""
    nodes: list[tuple] = []
    waiting = [(points, 0, -1, 0)]
    while waiting:
        part, depth, parent, side = waiting.pop()
        index = len(nodes)
        if parent >= 0:
            old = list(nodes[parent])
            old[2 + side] = index
            nodes[parent] = tuple(old)
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(part) <= 1 or len(usable) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + average_path(len(part))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes.append((feature, cut, -1, -1, float(depth)))
        waiting += [(part[goes_left], depth + 1, index, 0), (part[~goes_left], depth + 1, index, 1)]
    return nodes


@dataclass
class Forest:
    """Node tables of all trees, padded to one width."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is more isolated."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t][at]
                inner = f >= 0
                below = x[rows, np.where(inner, f, 0)] <= self.threshold[t][at]
                child = np.where(below, self.left[t][at], self.right[t][at])
                at = np.where(inner, child, at)
            total += self.path[t][at]
        return np.exp2(-total / len(self.feature) / max(average_path(self.sample), 1e-12))


def fit_forest(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42
) -> Forest:
    """Grow each tree from its own sample of rows; at most ``trees * sample`` rows leave the scan.

    ``keys`` should identify a row; when they are all columns, equal rows are counted as copies.
    """
    ship_package(df.sparkSession)
    wide = df.select(*[F.col(f"`{k}`").alias(f"k_{k}") for k in keys],
                     *[as_double(df, f).alias(f"f{i}") for i, f in enumerate(features)]).dropna(
        subset=[f"f{i}" for i in range(len(features))]
    )
    named = [f"k_{k}" for k in keys]
    points = [f"f{i}" for i in range(len(features))]
    total = wide.count()
    if total < 10:
        raise ValueError("an isolation forest needs at least ten complete rows")
    size = min(sample, total)
    pool = bounded_sample(wide, named, trees * size, total, seed, unique=set(keys) != set(df.columns))
    if total >= trees * size:
        # The pool is in random order: deal it to the trees in turn.
        numbered = pool.withColumn("tree", ((F.row_number().over(W.orderBy("__h")) - 1) % trees).cast("int"))
    else:
        each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        order = W.partitionBy("tree").orderBy(key_hash(named, seed, F.col("tree")), *named)
        numbered = each.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size)
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["__h", *points])[points].to_numpy(dtype=float)
        nodes = grow_tree(ordered, np.random.default_rng([seed, int(key[0])]), depth)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left_node", "right_node", "path"])
        return out.assign(tree=key[0], node=range(len(out)))

    schema = "feature int, threshold double, left_node int, right_node int, path double, tree int, node int"
    # At most 2·sample nodes per tree come back.
    grown = numbered.select("tree", "__h", *points).groupBy("tree").applyInPandas(grow, schema).toPandas()
    count, width = trees, int(grown["node"].max()) + 1
    shape = (count, width)
    arrays = {name: np.full(shape, fill) for name, fill in
              (("feature", -1), ("threshold", 0.0), ("left_node", 0), ("right_node", 0), ("path", 0.0))}
    for name, array in arrays.items():
        array[grown["tree"], grown["node"]] = grown[name]
    return Forest(arrays["feature"], arrays["threshold"], arrays["left_node"], arrays["right_node"], arrays["path"],
                  depth, size)


def forest_score(df: DataFrame, forest: Forest, features: Sequence[str]) -> Column:
    """Score column; null where a feature is missing."""
    ship_package(df.sparkSession)
    parts = (forest.feature, forest.threshold, forest.left, forest.right, forest.path, forest.depth, forest.sample)
    shared = df.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        x = frame.to_numpy(dtype=float)
        good = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if good.any():
            out[good] = Forest(*shared.value).score(x[good])
        return pd.Series(out)

    raw = score(F.struct(*[as_double(df, f).alias(f"f{i}") for i, f in enumerate(features)]))
    return F.nanvl(raw, F.lit(None).cast("double"))


def isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    contamination: float = 0.1,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
    small_values: int = SMALL_VALUES,
) -> DataFrame:
    """Every row with ``score`` (low = anomalous, null if incomplete) and ``is_anomaly``.

    The cut is the exact ``contamination`` quantile of the scores.
    """
    forest = fit_forest(df, features, keys, trees, sample, seed)
    scored = freeze(df.withColumn("score", -forest_score(df, forest, features)))
    cut = scalar_quantiles(scored, "score", {"cut": contamination}, small_values)["cut"]
    return scored.withColumn("is_anomaly", F.coalesce(F.col("score") < F.lit(cut), F.lit(False)))
