"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.storage import freeze


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node next to them; links may come twice.

    The large step moves neighbours above a node, the small step those below it; for
    the small one ``a`` is the larger end.  Links are dealt out once by ``a``, for the
    minimum and for the merge join that takes it back to them: no filter on one side only
    moves below that one shuffle, as the condition holds ``m``, never above ``a``.
    """
    links = (_ends(edges) if large else edges).where("a is not null and b is not null").repartition("a")
    lowest = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    joined = links.join(lowest.hint("merge"), F.col("a") == F.col("k"))
    if large:
        return joined.where(F.col("b") > F.greatest("a", "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    both = F.array(*[F.struct(F.col(end).alias("a"), F.col("m").alias("b")) for end in "ba"])
    return joined.select(F.inline(both)).where("a != b")


def _ends(edges: DataFrame) -> DataFrame:
    """Each edge (a, b), and turned round."""
    return edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _settled(state: DataFrame) -> bool:
    """Whether every node of distinct edges is linked to one smaller node only, or to larger ones only."""
    below = _ends(state).groupBy("a").agg(F.count_if(F.col("b") < F.col("a")).alias("below"), F.count(F.lit(1)).alias("n"))
    return below.where("below > 1 or (below = 1 and n > 1)").isEmpty()


def smaller_nodes(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b) that are not the smallest of their component.

    Large and small stars alternate until every node is linked to its component's
    smallest one and to no other, in a number of rounds that grows with the logarithm
    of the graph, not with its diameter.
    """
    state = freeze(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    while True:
        state = freeze(_star(_star(state, large=True), large=False).distinct())
        if _settled(state):
            return state.select(F.col("a").alias("node"), F.col("b").alias("component"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) where the component is its smallest node.

    ``nodes`` has a column ``node``, ``edges`` columns ``a`` and ``b``.
    """
    parents = smaller_nodes(edges)
    return nodes.join(parents, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
