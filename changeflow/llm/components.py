"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import any_row, stored


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) of a forest -> (node, root), by halving all paths until none gets shorter."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        halved = stored(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("root"), "parent"), "roots"
        )
        parents = halved.select("node", F.col("root").alias("parent"))
        if not any_row(halved.where("root != parent")):
            return parents.select("node", F.col("parent").alias("root"))


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest node that each linked node reaches.

    In each round every node hangs itself below its smallest neighbour, the trees shrink to their roots, and the links
    are carried over to the roots. At least half of the nodes that still have links vanish in a round. The smallest
    neighbour is a partial aggregate, so a node with a third of all links costs one row a task.
    Without links the result is empty.
    """
    edges = stored(links.where("a != b").select("a", "b").distinct(), "links")
    found = None
    while any_row(edges):
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parents = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        roots = _roots(stored(parents, "parents"))
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stored(
                found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found"
            )
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links"
        )
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
