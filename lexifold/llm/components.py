"""Connected components of a table of links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexifold.sources.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: two long node numbers) -> ``node, component``: the smallest node reachable, for every linked node.

    Each round gives every node the smallest of itself and its neighbours, follows that pointer once more, and
    rewrites the links between the nodes that are left; links within a node go, repeated ones become one. The
    smallest is an aggregate, combined before the shuffle, so a node with very many links is no burden. Every
    round is written, which cuts the lineage. Nulls link nothing.
    """
    left = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        near = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up"))
        near = materialize(near, "near")
        further = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = materialize(near.join(further, "up").select("node", F.col("top").alias("component")), "step")
        steps.append(step)
        ends = left
        for name in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(name), F.col("component").alias(f"new_{name}")), name)
        ends = ends.where("new_a <> new_b").select(
            F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")
        ).distinct()
        left = materialize(ends, "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """Where the nodes of an earlier round are after a later one."""
        moved = later.select(F.col("node").alias("component"), F.col("component").alias("last"))
        return earlier.join(moved, "component", "left").select("node", F.coalesce("last", "component").alias("component"))

    return reduce(follow, reversed(steps))
