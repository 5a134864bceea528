"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash of their place in the input; it
does not look at any column, so that no key, source or group of copies can make a bucket large.  Pass two shuffles each
bucket (Spark's array shuffle is Fisher-Yates) and writes it.  The buckets one after another are the shuffled corpus;
shards are equal stretches of it, whose row counts differ by one at most.

The input should be a stored table: a place in it must mean the same row when a task is run again.

Edge cases: a null text counts as empty; rows without an id and repeated rows are rows like any other; with fewer rows
than shards some shards are empty; an empty table gives no rows.  Columns of the names added here raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import checked_broadcast, stored

ADDED = ("bucket", "position", "shard", "slot")


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text and a header of 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffled(docs: DataFrame, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """docs with `bucket` and `position`, written bucket by bucket to the shared folder."""
    if clash := {c.lower() for c in docs.columns} & {*ADDED}:
        raise ValueError(f"the input has columns of these names already: {sorted(clash)}")
    total = docs.agg(F.sum(text_size())).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    place = F.monotonically_increasing_id()
    scattered = (
        docs.select(place.alias("place"), F.struct(*docs.columns).alias("record"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)))
        .repartition(buckets, "bucket")
    )
    # records arrive in any order, and are put in that of their places, so that the seed decides
    in_order = F.array_sort(
        F.collect_list(F.struct("place", "record")), lambda a, b: F.when(a["place"] < b["place"], -1).otherwise(1))
    whole = scattered.groupBy("bucket").agg(in_order.alias("records")).sortWithinPartitions("bucket")
    mixed = whole.select("bucket", F.shuffle("records", seed).alias("records"))
    spread = mixed.select("bucket", F.posexplode("records").alias("position", "row"))
    return stored(spread.select("bucket", "position", "row.record.*"), "shuffled")


def shards(docs: DataFrame, count: int = 40, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """docs, shuffled, with `shard` (0 to count - 1) and `slot` (gapless from 0 in each shard)."""
    rows = shuffled(docs, seed, bucket_bytes)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    # one row for each bucket, of which there are as many as memory-sized pieces of the corpus
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.select(
        F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n"), "bucket-offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0
    small, larger = total // count, total % count  # the first `larger` shards have one row more
    edge = larger * (small + 1)
    at = F.col("before") + F.col("position")
    first = at < edge
    shard = F.when(first, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / max(small, 1)))
    slot = F.when(first, at % (small + 1)).otherwise((at - edge) % max(small, 1))
    joined = rows.join(checked_broadcast(offsets.drop("n")), F.col("bucket") == F.col("of"))
    return joined.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop("of", "before")
