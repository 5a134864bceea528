"""Ranks and exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.session import cut_lineage


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, c, below, n): distinct values with their count, the rows below and the group's size.

    Values are counted first and then range-partitioned, so a group that holds most rows spreads over
    all tasks; positions follow from one summary row per (range, group).
    """
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # stored, because the range a row falls into is read twice
    ranged = cut_lineage(
        counts.repartitionByRange(*keys, "v").withColumn("_range", F.spark_partition_id())
    )
    by_group = W.partitionBy(*keys)
    offsets = ranged.groupBy("_range", *keys).agg(F.sum("c").alias("_c")).select(
        "_range", *keys,
        F.coalesce(
            F.sum("_c").over(by_group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_c").over(by_group).alias("n"),
    )
    inside = W.partitionBy("_range", *keys).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .join(offsets, ["_range", *keys])
        .select(*keys, "v", "c", (F.col("_offset") + F.col("_inside")).alias("below"), "n")
    )


def exact_percentiles(ranks: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per entry of `shares`.

    The two order statistics around each position are picked by conditional aggregates.
    """
    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("c"))
        return F.max(F.when(hit, F.col("v")))

    picks = []
    for name, share in shares.items():
        position = (F.col("n") - 1) * F.lit(share)
        picks += [
            at(F.floor(position)).alias(f"{name}_lo"), at(F.ceil(position)).alias(f"{name}_hi"),
            F.max(position - F.floor(position)).alias(f"{name}_t"),
        ]
    stats = ranks.groupBy(*keys).agg(*picks)
    return stats.select(
        *keys,
        *[
            ((1 - F.col(f"{n}_t")) * F.col(f"{n}_lo") + F.col(f"{n}_t") * F.col(f"{n}_hi")).alias(n) for n in shares
        ],
    )
