"""Connected components of a graph in tables, by alternating large and small stars.

Each round hooks neighbours to the least node around. It takes aggregates (combined before they are
shuffled) and joins on the node, from which nodes with very many edges are taken out, so no list of
neighbours is ever gathered. Rounds grow with the logarithm of the nodes; each is a table in the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, grown, join_keys


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node of its component) for every node with an edge; `edges`: long columns a, b
    in any direction. An empty table gives an empty one."""

    def star(e: DataFrame, n: int) -> DataFrame:
        """From n pairs a > b: all neighbours of a node, hooked to the least of them."""
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_keys(both.where("b > a"), least, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # now every node's smaller neighbours are hooked to the least of those
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(grown(low), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)") + F.col("b")), F.sum(F.hash("a", "b").cast("long"))).first()

    now = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    while True:
        after = scratch.write(star(now, was[0]))
        scratch.drop(now)
        now, before, was = after, was, state(after)
        if was == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
