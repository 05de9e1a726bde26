"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is an aggregate and a join on nodes; rounds are written to the shared folder, so a
lost executor repeats one round at most. Rounds grow with the logarithm of the largest
component, and each node ends with one edge to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.session import materialize


def _least(edges: DataFrame) -> DataFrame:
    """node -> least of itself and its neighbours in ``edges`` (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is not its component's least one.

    Nodes can be of any type with an order. Loops, repeated edges and edges with a null end
    don't matter; without edges the result is empty.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(edges[a].isNotNull() & edges[b].isNotNull() & (edges[a] != edges[b]))
    links = materialize(links.distinct(), "components")
    before = None
    while True:
        # Large star: each larger neighbour goes to the least of the neighbourhood.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.distinct()
        # Small star: the node and its smaller neighbours go to the least of them.
        joined = large.join(_least(large), "u")
        small = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v")))
        links = materialize(small.where("u != v").distinct(), "components")
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (state["n"], state["h"])
