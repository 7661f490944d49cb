"""Connected components of an edge table by alternating minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxmill.llm.common import stash


def connected(edges: DataFrame, steps: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root being the smallest node reachable.

    Each round hooks every root on the smallest root next to its tree, then
    halves all paths, so rounds grow with the logarithm of the longest chain.
    Edges between nodes of one root are dropped on the way.  Labels and edges are
    written to the shared folder each round; nothing is collected.  Grouping
    takes minima only, so a node with very many links is aggregated before its
    shuffle.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    label = stash(nodes.select("node", F.col("node").alias("root")), "cc-label")
    for _ in range(steps):
        if edges.isEmpty():
            return label
        # between roots a > b: hook a on its smallest neighbour
        hook = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to"))
        # hooks form chains to ever smaller roots; jump along them until all are flat
        hook = stash(hook, "cc-hook")
        while True:
            onward = hook.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = stash(hook.join(onward, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "cc-jump")
            moved = not jumped.where("moved").isEmpty()
            hook = jumped.select("root", "to")
            if not moved:
                break
        label = stash(label.join(hook, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc-label")
        ends = hook.select(F.col("root").alias("a"), F.col("to").alias("a_to"))
        other = hook.select(F.col("root").alias("b"), F.col("to").alias("b_to"))
        moved_edges = edges.join(ends, "a", "left").join(other, "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        edges = stash(moved_edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    raise RuntimeError("components did not settle")
