"""Connected components by contraction, for edges of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); names should be in random order, such as digests.

    Each round joins every node to its smallest neighbour and replaces the edges by those between what was joined, so
    the graph shrinks by a share each time, also along paths; minima are combined before the shuffle, so a node with
    very many edges is no burden. Then the rounds are followed from the last to the first.
    """
    rounds = []
    edges = stage(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("root")), "up")
        rounds.append(up)
        edges = stage(
            edges.join(up.withColumnRenamed("root", "x"), "a").join(up.select(F.col("a").alias("b"), F.col("root").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node's minimum may itself have moved on in the same round: follow that first
    out = None
    for up in reversed(rounds):
        step = up.select(F.col("a").alias("node"), "root")
        if out is not None:
            step = step.join(out.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select(
                "node", F.coalesce("last", "root").alias("root"))
        out = stage(step, "roots")
    return out
