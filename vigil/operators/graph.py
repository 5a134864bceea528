"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its smallest node.

    Each node points at a smaller or equal one.  In a round, the root of a tree hooks on to the smallest root that an edge
    from its tree leads to, if that is smaller, then every node jumps to the root of its tree, twice as far each time.
    Long chains shrink by jumps, not by a round for each step.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    names = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("root")))
    while True:
        names = flattened(names)
        left = names.select(F.col("node").alias("a"), F.col("root").alias("from"))
        right = names.select(F.col("node").alias("b"), F.col("root").alias("to"))
        across = both.join(left, "a").join(right, "b").where(F.col("to") < F.col("from"))
        hooks = cut_lineage(across.groupBy("from").agg(F.min("to").alias("to")))
        if hooks.isEmpty():
            return names.select("node", F.col("root").alias("component"))
        moved = names.join(hooks, F.col("node") == F.col("from"), "left")
        names = cut_lineage(moved.select("node", F.coalesce("to", "root").alias("root")))


def flattened(names: DataFrame) -> DataFrame:
    """(node, root) with every node at the root of its tree; each round doubles how far a node sees."""
    while True:
        ahead = names.select(F.col("node").alias("at"), F.col("root").alias("further"))
        jumped = cut_lineage(names.join(ahead, names["root"] == ahead["at"], "left").select(
            "node", F.coalesce("further", "root").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        names = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return names
