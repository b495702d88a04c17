"""Distributed connected components with DataFrame functions only.

Every round hooks each node to its smallest neighbour below it, jumps pointers until each hooked node points at the
root of its tree, and replaces edges by edges between roots. A node that has a smaller neighbour is gone after a round,
and at least half of the remaining nodes of any path have one or are one, so rounds grow with the logarithm of the
longest path. Minima are aggregated before they are shuffled, and edges of a hub are distinct again after each round.
Tables between rounds are written to the shared folder, so no lineage grows and nothing depends on one executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for each node of the edges a, b. Edges with a null are none.

    The result is a stored table; those of the rounds are gone.
    """
    first = materialise(_distinct_edges(edges), "edges")
    current, maps, stored = first, [], [first]
    while not current.isEmpty():
        parents = materialise(current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "parents")
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            moved = parents.join(above, "up", "left")
            jumped = materialise(moved.select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents")
            discard(parents)
            parents = jumped
            if jumped.where("moved").isEmpty():
                break
        stored.append(jumped)
        parents = jumped.select("node", "up")
        maps.append(parents)
        a = parents.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        b = parents.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        merged = current.join(b, "b").join(a, "a", "left").select(F.coalesce("a_up", "a").alias("a"), F.col("b_up").alias("b"))
        contracted = materialise(_distinct_edges(merged), "edges")
        if current is not first:
            discard(current)
        current = contracted
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for parents in maps:
        nodes = nodes.join(parents.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    nodes = materialise(nodes, "roots")
    for table in stored if current is first else [*stored, current]:
        discard(table)
    return nodes
