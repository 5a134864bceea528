"""Repeat-asset alert bursts: greedy, non-overlapping windows per (entity, asset).

A burst starts at the first alert whose window [t, t + w] holds enough alerts; the next one starts at
the first such alert after t + w.  The work is cut by time, never by asset alone:

1. alerts are reduced to one tick per (entity, asset, instant);
2. window counts come from prefix sums inside slices as wide as the window, each slice extended by
   a copy of the next one;
3. only ticks that could start a burst go on.  A pause longer than the window restarts the greedy
   choice, so they split into independent chains;
4. short chains are folded as an array, long ones (one very busy asset) are resolved by pointer
   doubling with equi joins, so neither a task nor an array ever holds an unbounded asset.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import first_of, stable_id
from vigil.schema import is_high, of_type
from vigil.session import cut_lineage

KEY = ["entity_id", "asset"]
FOLD_LIMIT = 20_000  # longest chain of candidate instants folded in one array


def burst_alerts(events: DataFrame) -> DataFrame:
    """Alerts with a usable asset and time."""
    asset = F.trim("asset_id")
    return (
        of_type(events, "alert_metadata")
        .where((asset != "") & (F.lower(asset) != "none") & F.col("event_timestamp").isNotNull())
        .select(
            "entity_id", asset.alias("asset"), "event_id", "raw_row_index",
            F.unix_micros("event_timestamp").alias("t"),
            is_high().cast("int").alias("high"),
            first_of("rule_id", "action", F.lit("Alert")).alias("rule"),
        )
    )


def burst_candidates(alerts: DataFrame, width: int, min_alerts: int, min_high: int) -> DataFrame:
    """Instants whose window holds a burst: (entity, asset, t, slice)."""
    ticks = (
        alerts.groupBy(*KEY, "t")
        .agg(F.count("*").alias("n"), F.sum("high").alias("h"))
        .withColumn("own", F.floor(F.col("t") / F.lit(width)).cast("bigint"))
    )
    spread = ticks.withColumn("slice", F.explode(F.array(F.col("own"), F.col("own") - 1)))
    order = W.partitionBy(*KEY, "slice").orderBy("t")
    # growing frames only: each is maintained incrementally, unlike a sliding frame
    until = order.rangeBetween(W.unboundedPreceding, width)
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    counted = spread.select(
        *KEY, "t", "slice", "own",
        (F.sum("n").over(until) - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("n"),
        (F.sum("h").over(until) - F.coalesce(F.sum("h").over(earlier), F.lit(0))).alias("h"),
    )
    return counted.where(
        (F.col("slice") == F.col("own")) & ((F.col("n") >= min_alerts) | (F.col("h") >= min_high))
    ).select(*KEY, "t", "slice")


def _chains(candidates: DataFrame, width: int) -> DataFrame:
    """Add the chain of each candidate and that chain's size, from one summary row per slice."""
    by_asset = W.partitionBy(*KEY).orderBy("slice")
    slices = (
        candidates.groupBy(*KEY, "slice")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
        .withColumn("pause", F.col("first") - F.lag("last").over(by_asset))
        .withColumn("next_first", F.lead("first").over(by_asset))
        .withColumn("restart", (F.col("pause").isNull() | (F.col("pause") > width)).cast("int"))
        .withColumn("chain", F.sum("restart").over(by_asset))
    )
    by_chain = W.partitionBy(*KEY, "chain")
    sized = slices.select(
        *KEY, "slice", "chain", "next_first",
        F.sum("n").over(by_chain).alias("chain_size"),
        F.count("*").over(by_chain).alias("chain_slices"),
        F.min("first").over(by_chain).alias("chain_first"),
    )
    return candidates.join(sized, [*KEY, "slice"])


def _folded_starts(chained: DataFrame, width: int) -> DataFrame:
    """Greedy choice by a fold over the sorted instants of a bounded chain."""
    state = F.struct(
        F.lit(None).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("starts")
    )

    def step(s, t):
        taken = F.struct((t + F.lit(width)).alias("end"), F.array_append(s["starts"], t).alias("starts"))
        return F.when(s["end"].isNull() | (t > s["end"]), taken).otherwise(s)

    return (
        chained.groupBy(*KEY, "chain")
        .agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select(*KEY, F.explode(F.aggregate("ts", state, step, lambda s: s["starts"])).alias("start"))
    )


def _doubled_starts(chained: DataFrame, width: int) -> DataFrame:
    """Greedy choice by pointer doubling: each round doubles how far a pointer jumps.

    A chain has at most one start per slice, so log2(slices) rounds reach its end.
    """
    longest = chained.agg(F.max("chain_slices")).first()[0]
    # next start of t: the first candidate after t + width, in the following slice or a later one
    asked = chained.select(
        *KEY, (F.col("slice") + 1).alias("slice"), F.col("t").alias("origin"),
        (F.col("t") + F.lit(width)).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("cand"),
    )
    present = chained.select(
        *KEY, "slice", F.lit(None).cast("bigint").alias("origin"),
        F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("t").alias("cand"),
    )
    # descending, a question comes before a candidate at the same instant and so does not see it
    back = W.partitionBy(*KEY, "slice").orderBy(F.desc("at"), "kind").rowsBetween(W.unboundedPreceding, 0)
    answered = (
        asked.unionByName(present)
        .withColumn("found", F.min("cand").over(back))
        .where(F.col("kind") == 0)
        .select(*KEY, F.col("origin").alias("t"), "found")
    )
    # otherwise the first candidate of the next non-empty slice of the same chain after that
    ends = chained.select(*KEY, "chain", "slice", "t", "next_first").join(answered, [*KEY, "t"])
    firsts = chained.groupBy(*KEY, "chain", "slice").agg(F.min("t").alias("first"))
    ordered = firsts.withColumn(
        "later", F.collect_list("first").over(
            W.partitionBy(*KEY, "chain").orderBy("slice").rowsBetween(1, 2)
        )
    ).select(*KEY, "chain", "slice", "later")
    jump = F.coalesce(
        F.col("found"),
        F.get(F.filter("later", lambda x: x > F.col("t") + F.lit(width)), F.lit(0)),
    )
    pointers = cut_lineage(
        ends.join(ordered, [*KEY, "chain", "slice"]).select(*KEY, "t", jump.alias("next"))
    )
    marked = chained.where(F.col("t") == F.col("chain_first")).select(*KEY, "t").distinct()
    for _ in range(max(1, ceil(log2(longest + 1)))):
        reached = marked.join(pointers, [*KEY, "t"]).where(F.col("next").isNotNull()).select(
            *KEY, F.col("next").alias("t")
        )
        marked = cut_lineage(marked.unionByName(reached).distinct())
        hop = pointers.select(*KEY, F.col("t").alias("next"), F.col("next").alias("after"))
        pointers = cut_lineage(
            pointers.join(hop, [*KEY, "next"], "left").select(*KEY, "t", F.col("after").alias("next"))
        )
    return marked.withColumnRenamed("t", "start")


def burst_starts(
    candidates: DataFrame, width: int, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """(entity, asset, start) of the greedy non-overlapping bursts."""
    chained = cut_lineage(_chains(candidates, width))  # read several times, and decides the plan
    short = _folded_starts(chained.where(F.col("chain_size") <= fold_limit), width)
    long_chains = chained.where(F.col("chain_size") > fold_limit)
    if long_chains.isEmpty():
        return short
    return short.unionByName(_doubled_starts(long_chains, width))


def find_bursts(
    events: DataFrame,
    window_seconds: int = 86400,
    min_alerts: int = 5,
    min_high: int = 3,
    fold_limit: int = FOLD_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(clusters, members). Members are the complete long-form evidence, one row per alert."""
    width = window_seconds * 1_000_000
    alerts = burst_alerts(events)
    starts = burst_starts(burst_candidates(alerts, width, min_alerts, min_high), width, fold_limit)
    reach = starts.withColumn("own", F.floor(F.col("start") / F.lit(width)).cast("bigint")).select(
        *KEY, "start", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("slice")
    )
    members = (
        alerts.withColumn("slice", F.floor(F.col("t") / F.lit(width)).cast("bigint"))
        .join(reach, [*KEY, "slice"])
        .where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("start") + F.lit(width)))
        .select(
            stable_id(F.lit("burst"), "entity_id", "asset", "start").alias("cluster_id"),
            "entity_id", F.col("asset").alias("asset_id"), "event_id", "raw_row_index", "t", "high", "rule", "start",
        )
    )
    clusters = members.groupBy("cluster_id", "entity_id", "asset_id").agg(
        F.count("*").alias("alert_count"),
        F.sum("high").alias("high_critical_count"),
        # rule names form a catalogue, its size does not follow the rows
        F.array_sort(F.collect_set("rule")).alias("distinct_rules"),
        F.timestamp_micros(F.min("t")).alias("time_window_start"),
        F.timestamp_micros(F.max("t")).alias("time_window_end"),
        F.min_by("event_id", F.struct("t", "raw_row_index", "event_id")).alias("first_event_id"),
    )
    return clusters, members.select("cluster_id", "entity_id", "asset_id", "event_id", "raw_row_index", "t")


# Shape shared by all correlation edges.
EDGE_COLUMNS = (
    "correlation_id", "entity_id", "correlation_type", "primary_event_id", "correlated_event_id",
    "asset_id", "similarity_score", "shared_attributes", "rationale",
)


def burst_edges(clusters: DataFrame, members: DataFrame, window_seconds: int = 86400) -> DataFrame:
    """Star from the first alert of a burst to each later one."""
    hours = f"{window_seconds / 3600:.1f}"
    joined = members.select("cluster_id", "event_id").join(clusters, "cluster_id").where(
        F.col("event_id") != F.col("first_event_id")
    )
    return joined.select(
        stable_id(F.lit("REPEAT_ASSET_ALERT"), "cluster_id", "event_id").alias("correlation_id"),
        "entity_id",
        F.lit("REPEAT_ASSET_ALERT").alias("correlation_type"),
        F.col("first_event_id").alias("primary_event_id"),
        F.col("event_id").alias("correlated_event_id"),
        "asset_id",
        F.lit(1.0).alias("similarity_score"),
        F.create_map(
            F.lit("cluster_id"), F.col("cluster_id"),
            F.lit("burst_alert_count"), F.col("alert_count").cast("string"),
            F.lit("high_critical_count"), F.col("high_critical_count").cast("string"),
            F.lit("distinct_rules"), F.array_join("distinct_rules", ","),
            F.lit("window_hours"), F.lit(hours),
        ).alias("shared_attributes"),
        F.format_string(
            "Same-asset alert burst on %s: %s alerts fired within 24h (%s High/Critical), indicating "
            "persistent unmitigated root cause.", "asset_id", "alert_count", "high_critical_count",
        ).alias("rationale"),
    )
