"""Merkle roots over leaf digests, for any number of trees at once.

A level sorts its digests, hashes neighbours pairwise (an odd last one with itself) and repeats.
Large trees shrink level by level with a distributed sort; once a tree has at most `tail` digests,
its remaining levels run on one bounded array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.canonical import EMPTY_DIGEST
from vigil.functions.scalars import c
from vigil.session import cut_lineage

TAIL = 8192


MODES = ("sorted_levels", "sorted_once")


def _parent(left: Column, right: Column, mode: str) -> Column:
    """Digest of two digests: of their hex text, or in the sorted-once variant of their bytes."""
    if mode == "sorted_once":
        left, right = F.unhex(left), F.unhex(right)
    return F.sha2(F.concat(left, right), 256)


def _level(digests: Column, mode: str) -> Column:
    """Next level of one array of digests."""
    ordered = F.array_sort(digests) if mode == "sorted_levels" else digests
    # binding the array once keeps the level at one sort
    return F.transform(
        F.array(ordered),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 2).cast("int")),
            lambda i: _parent(F.get(s, 2 * i), F.coalesce(F.get(s, 2 * i + 1), F.get(s, 2 * i)), mode),
        ),
    )[0]


def root_of_array(digests: Column | str, mode: str = "sorted_levels") -> Column:
    """Root of a bounded array of hex digests; the empty tree has the digest of nothing."""
    lowered = F.transform(c(digests), lambda d: F.lower(d))
    levels = F.ceil(F.log2(F.greatest(F.size(c(digests)), F.lit(2)))).cast("int")
    root = F.aggregate(
        F.sequence(F.lit(1), levels),
        lowered,
        lambda acc, _: F.when(F.size(acc) <= 1, acc).otherwise(_level(acc, mode)),
    )
    return F.coalesce(F.get(root, F.lit(0)), F.lit(EMPTY_DIGEST))


def _shrink(leaves: DataFrame, keys: list[str], order: list[str], mode: str) -> DataFrame:
    """One level of all trees: a range-partitioned sort, ranks from per-partition counts, pairing.

    Ranges split a tree that holds most of the digests over all tasks.
    """
    ordered = cut_lineage(
        leaves.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id())
    )
    sizes = ordered.groupBy("part", *keys).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    # one row per (partition, tree)
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rank = F.col("seq") - F.col("first") + F.col("offset")
    pairs = (
        ordered.join(offsets, ["part", *keys])
        .withColumn("rank", rank)
        .groupBy(*keys, F.floor(F.col("rank") / 2).alias("pos"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("d"))  # two digests
    )
    left, right = F.col("d")[0]["digest"], F.get("d", F.lit(1))["digest"]
    return pairs.select(*keys, "pos", _parent(left, F.coalesce(right, left), mode).alias("digest"))


def merkle_roots(
    leaves: DataFrame, keys: list[str], digest: str = "digest", tail: int = TAIL, mode: str = "sorted_levels"
) -> DataFrame:
    """(keys, leaf_count, root) of the trees found in `leaves`.

    `sorted_once` is the variant used for evaluation data: digests are sorted at the bottom only and
    hashed as bytes.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    leaves = leaves.select(*keys, F.lit(0).cast("bigint").alias("pos"), F.lower(digest).alias("digest"))
    # all leaves have position 0, so the bottom level is sorted by digest in both modes
    order = ["digest"] if mode == "sorted_levels" else ["pos", "digest"]
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("leaf_count"))
    largest = sizes.agg(F.max("leaf_count")).first()[0] or 0
    if largest <= tail:
        return _tail_roots(leaves, keys, order, mode)
    sizes = cut_lineage(sizes)
    current = sizes.withColumnRenamed("leaf_count", "n").where(F.col("n") > tail)
    done = [leaves.join(current.select(*keys), keys, "left_anti")]
    pending = leaves.join(current.select(*keys), keys, "left_semi")
    while largest > tail:  # log2(largest / tail) rounds, each on half the digests
        level = cut_lineage(_shrink(pending, keys, order, mode))
        largest = (largest + 1) // 2
        current = current.withColumn("n", F.ceil(F.col("n") / 2))
        done.append(level.join(current.where(F.col("n") <= tail).select(*keys), keys, "left_semi"))
        current = current.where(F.col("n") > tail)
        pending = level.join(current.select(*keys), keys, "left_semi")
    remaining = reduce(DataFrame.unionByName, done)
    return sizes.join(_tail_roots(remaining, keys, order, mode).select(*keys, "root"), keys)


def _tail_roots(leaves: DataFrame, keys: list[str], order: list[str], mode: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], "digest")))
    return (
        leaves.groupBy(*keys)
        .agg(F.count("*").alias("leaf_count"), ordered.alias("d"))
        .select(*keys, "leaf_count", root_of_array(F.transform("d", lambda x: x["digest"]), mode).alias("root"))
    )


def composite_root(*roots: Column | str) -> Column:
    """Digest of the sorted subtree roots."""
    parts = F.transform(F.array(*[c(r) for r in roots]), lambda r: F.lower(r))
    return F.sha2(F.array_join(F.array_sort(parts), ""), 256)
