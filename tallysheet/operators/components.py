"""Connected components by parallel hooking and shortcutting over a parent table.

The parent array is a joined table (node, parent). Each round hooks the larger root of every edge
onto the smallest root it is linked to and then shortcuts parents to their grandparents; rounds end
when no edge joins two roots, after a number of rounds logarithmic in the longest chain. Every round
is cut with a reliable checkpoint, so lost executors cost no recomputation of earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.session import cut


def hook_and_shortcut(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for every row of ``nodes(node)``; edges(a, b) may repeat or loop.

    The component is its smallest node. NULL nodes and edges with a NULL end are ignored; an empty
    edge table leaves every node alone.
    """
    parent = nodes.where("node is not null").select("node").distinct().withColumn("parent", F.col("node"))
    edges = cut(edges.where("a <> b").select("a", "b").distinct())
    if edges.isEmpty():
        return parent.select("node", F.col("parent").alias("component"))
    parent = cut(parent)
    while True:
        at_a, at_b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        roots = cut(edges.join(at_a, "a").join(at_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        if roots.isEmpty():
            return _flatten(parent).select("node", F.col("parent").alias("component"))
        hooks = roots.select(F.greatest("a", "b").alias("parent"), F.least("a", "b").alias("hook")).groupBy("parent").agg(F.min("hook").alias("hook"))
        hooked = parent.join(hooks, "parent", "left").select("node", F.coalesce("hook", "parent").alias("parent"))
        parent = cut(_shortcut(hooked).select("node", F.col("grand").alias("parent")))
        edges = roots


def _shortcut(parent: DataFrame) -> DataFrame:
    """(node, parent, grand)."""
    return parent.join(parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent")


def _flatten(parent: DataFrame) -> DataFrame:
    """Shortcutting until every parent is a root; chains halve in each round."""
    while True:
        up = cut(_shortcut(parent))
        parent = up.select("node", F.col("grand").alias("parent"))
        if up.where("parent <> grand").isEmpty():
            return parent
