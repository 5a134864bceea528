"""Connected components of very large graphs by alternating large and small stars.

Every round hangs the neighbours of each node below the smallest of them, with an aggregation and a join, and
writes the edges to the shared folder.  The number of rounds grows with the logarithm of the longest path; a hub
with very many edges is summed before the shuffle, and its join is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that can be reached.

    Loops, repeated edges, and edges with a null end are ignored; without edges there are no rows.
    """
    proper = edges.where(F.col("a") != F.col("b"))
    now = stored(proper.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while mark != (mark := fingerprint(now)):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        named = root.select(F.col("u").alias("w"), "m")
        small = large.join(named, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fingerprint(edges: DataFrame) -> tuple:
    """The same for the same set of edges."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    row = edges.agg(F.count("*"), F.sum(hashed), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
