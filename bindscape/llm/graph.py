"""Connected components by contraction of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindscape.functions.session import settle


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another node; ``root`` is
    one node of its component, the same for all of them.

    In each round every node moves to the least of itself and its neighbours;
    edges are relabelled, and those inside one node go.  The number of rounds
    is about the logarithm of the longest chain.  Every round is written to the
    shared folder, so a lost executor costs only re-reads.
    """
    e = settle(
        edges.where(F.col(left) != F.col(right))
        .select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .distinct()
    )
    labels = None
    while not e.isEmpty():
        near = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        step = near.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("to")))
        step = step.groupBy("node").agg(F.min("to").alias("to"))
        # a second hop along the moves halves the chains
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = settle(step.join(hop, "to", "left").select("node", F.coalesce("further", "to").alias("to")))
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            moved = step.select(F.col("node").alias("root"), "to")
            labels = settle(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        one = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        e = settle(
            two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return labels
