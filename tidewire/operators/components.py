"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Each round gives every node the least name among its own and its neighbours' and then follows that name one step
    further, so the rounds grow with the logarithm of the longest path. Names come by aggregation with a map-side step, so
    a hub costs one row per task; lineage is cut each round. Loops, repeated and reversed edges change nothing; no edges
    give no rows. Raises if ``most_rounds`` don't suffice.
    """
    edges = edges.select("a", "b")
    both = cut(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    named = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node")
    named = cut(named)
    for _ in range(most_rounds):
        heard = both.join(named, both.b == named.node).select(F.col("a").alias("node"), "component")
        least = named.union(heard).groupBy("node").agg(F.min("component").alias("component"))
        further = named.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut(least.join(further, "component").select("node", F.least("component", "further").alias("component")))
        changed = after.join(named.withColumnRenamed("component", "before"), "node").filter(F.col("component") != F.col("before"))
        done = changed.isEmpty()
        named = after
        if done:
            return named
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
