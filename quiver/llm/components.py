"""Connected components of an edge table, by contraction in the shuffle.

Each round hooks every node to its smallest smaller neighbour, follows those
pointers to their roots, and keeps only the edges between different roots.
Nothing is collected but one row count a round; every round's tables are
written to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) from (node, root) pointers that lead to smaller nodes, by pointer jumping."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        # two jumps a round; a pointer that still moved at the second may have further to go
        once = parent.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        jumped = C.written(once.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")), "roots")
        parent = jumped.select("node", "root")
        if not jumped.where("moved").limit(1).count():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node that has an edge, and the smallest node it reaches.

    ``edges`` has two integer columns a, b; loops, nulls, repeats and either
    direction are accepted; without edges the result is empty."""
    left = C.written(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    labels = None
    while labels is None or left.limit(1).count():
        parent = _roots(C.written(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks"))
        # smallest nodes hook to nothing: they are their own roots
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = C.written(labels.unionByName(parent.join(labels, "node", "left_anti")), "labels")
        ends = left
        for end in ("hi", "lo"):
            ends = ends.join(parent.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(
                end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
        left = C.written(ends.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    return labels.unionByName(labels.select(F.col("root").alias("node"), "root").distinct().join(labels, "node", "left_anti"))
