"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, spend


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): equal labels mean connected.

    In each round every node moves onto its smallest neighbour, if smaller, and edges follow their ends. What is left shrinks
    geometrically; rounds end when no edge joins different nodes. Edges, maps and labels stay distributed, each round is cut and its tables go
    with the next; the labels are a written table, which the caller spends.
    """
    rest = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "step")
        if labels is None:
            labels = cut(step.select("node", F.col("to").alias("label")), "labels")
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            before, labels = labels, cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            spend(before)
        one, two = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        ends = rest.join(one, "a").join(two, "b").filter("x <> y")
        before, rest = rest, cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        spend(before, step)
    spend(rest)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, label long")
    return labels
