"""Existence joins with alternative keys and a time interval.

"Some target shares one of my keys and lies within [t - before, t + after]" is answered without
comparing rows pairwise.  Targets are first reduced to one summary row per (entity, key, time slot),
where a slot is as wide as the interval.  For a primary row in slot b it is then enough to look at

* the latest and earliest target of slot b,
* the latest target of slot b-1 and the earliest target of slot b+1,

all of which the reduction stores on slot b.  The reduction combines map-side, so a hot key is
shuffled as one row per slot however many targets it has, and the join is a plain equi semi join
whose build side is unique per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import non_blank
from vigil.operators.conditions import Condition, compile_condition, field_column
from vigil.schema import of_type

ANY_TIME = -(2**62)  # slot used when one of the two times is missing


@dataclass(frozen=True)
class TemporalJoin:
    """EXISTS / NOT_EXISTS test against another dataset."""

    target_dataset: str
    join_key: str = "raw_ref_id"
    fallback_key: str | None = None
    relation: str = "NOT_EXISTS"
    max_seconds: int | None = None
    min_seconds: int | None = None  # targets nearer in time than this don't count
    target_condition: Condition | None = None

    def __post_init__(self) -> None:
        if self.relation not in ("EXISTS", "NOT_EXISTS"):
            raise ValueError(f"unknown relation {self.relation!r}")
        if self.min_seconds and (self.max_seconds is None or self.max_seconds < self.min_seconds):
            raise ValueError("a minimum time distance needs a maximum that is not less")


def key_array(*keys: Column | str) -> Column:
    """Distinct non-blank keys of a row."""
    return F.array_distinct(F.array_compact(F.array(*[non_blank(k) for k in keys])))


def _summaries(targets: DataFrame, width: int | None, before: bool) -> DataFrame:
    """One row per (entity_id, key, slot) with the extreme times needed for existence tests."""
    t = F.col("t")
    null = F.lit(None).cast("bigint")

    def entry(slot: Column, own: Column, prev: Column, nxt: Column) -> Column:
        return F.struct(
            slot.alias("slot"), own.alias("own"), prev.alias("prev"), nxt.alias("nxt"),
            t.isNull().alias("untimed"),
        )

    any_time = entry(F.lit(ANY_TIME), null, null, null)
    if width is None:
        entries = F.array(any_time)
    else:
        slot = F.floor(t / F.lit(width)).cast("bigint")
        timed = [any_time, entry(slot, t, null, null), entry(slot - 1, null, null, t)]
        if before:
            timed.append(entry(slot + 1, null, t, null))
        entries = F.when(t.isNull(), F.array(any_time)).otherwise(F.array(*timed))
    return (
        targets.select("entity_id", "key", F.explode(entries).alias("s"))
        .groupBy("entity_id", "key", F.col("s.slot").alias("slot"))
        .agg(
            F.min("s.own").alias("own_min"),
            F.max("s.own").alias("own_max"),
            F.max("s.prev").alias("prev_max"),
            F.min("s.nxt").alias("nxt_min"),
            F.bool_or("s.untimed").alias("untimed"),
        )
    )


def matched_ids(
    primary: DataFrame,
    targets: DataFrame,
    *,
    primary_keys: Column,
    target_keys: Column,
    primary_time: Column | str = "event_timestamp",
    target_time: Column | str = "event_timestamp",
    id_column: str = "event_id",
    before_seconds: int | None = None,
    after_seconds: int | None = None,
) -> DataFrame:
    """(entity_id, id) of primary rows having a target with a common key inside the interval.

    With no bounds the keys alone decide.  A missing time on either side counts as a match.
    Bounds must be (0, w) or (w, w): only then do slot extremes decide membership exactly.
    """
    width = None
    if after_seconds is not None:
        if before_seconds not in (0, after_seconds):
            raise ValueError("interval must be [0, w] or [-w, w]")
        width = max(int(after_seconds * 1_000_000), 1)
    before = bool(before_seconds)

    def micros(column: Column | str) -> Column:
        return F.unix_micros(F.col(column) if isinstance(column, str) else column)

    summaries = _summaries(
        targets.select("entity_id", F.explode(target_keys).alias("key"), micros(target_time).alias("t")),
        width,
        before,
    )
    probe = primary.select(
        "entity_id", id_column, F.explode(primary_keys).alias("key"), micros(primary_time).alias("t")
    )
    t = F.col("t")
    if width is None:
        slots = F.array(F.lit(ANY_TIME))
    else:
        own_slot = F.floor(t / F.lit(width)).cast("bigint")
        slots = F.when(t.isNull(), F.array(F.lit(ANY_TIME))).otherwise(F.array(F.lit(ANY_TIME), own_slot))
    probe = probe.withColumn("slot", F.explode(slots))

    on = ["entity_id", "key", "slot"]
    p, s = probe.alias("p"), summaries.alias("s")
    equal = [F.col(f"p.{name}") == F.col(f"s.{name}") for name in on]
    if width is None:
        inside = F.lit(True)
    else:
        pt = F.col("p.t")
        low = pt - F.lit(width) if before else pt
        high = pt + F.lit(width)
        untimed = (F.col("p.slot") == ANY_TIME) & (pt.isNull() | F.col("s.untimed"))
        timed = (
            ((F.col("s.own_max") >= low) & (F.col("s.own_min") <= high))
            | (F.col("s.nxt_min") <= high)
            | (F.col("s.prev_max") >= low)
        )
        inside = untimed | F.coalesce(timed, F.lit(False))
    condition = inside
    for e in equal:
        condition = e & condition
    return p.join(s, condition, "left_semi").select("entity_id", id_column)


def with_match(primary: DataFrame, ids: DataFrame, id_column: str = "event_id") -> DataFrame:
    return primary.join(ids, ["entity_id", id_column], "left_semi")


def without_match(primary: DataFrame, ids: DataFrame, id_column: str = "event_id") -> DataFrame:
    return primary.join(ids, ["entity_id", id_column], "left_anti")


def temporal_join(primary: DataFrame, join: TemporalJoin | None, events: DataFrame) -> DataFrame:
    """Primary rows passing an EXISTS / NOT_EXISTS test; keys may match across key and fallback."""
    if join is None:
        return primary
    targets = of_type(events, join.target_dataset)
    targets = targets.where(compile_condition(join.target_condition, targets))

    def keys(df: DataFrame, *names: str | None) -> Column:
        return key_array(*[field_column(df, n)[0].cast("string") for n in names if n])

    def ids_of(**bounds) -> DataFrame:
        return matched_ids(
            primary,
            targets,
            primary_keys=keys(primary, join.join_key, join.fallback_key),
            target_keys=keys(targets, "raw_ref_id", join.join_key, join.fallback_key),
            **bounds,
        )

    if join.min_seconds:
        # after, from the minimum to the maximum distance; and before, the same interval mirrored
        width = join.max_seconds - join.min_seconds
        after, before = (
            ids_of(
                primary_time=F.timestamp_micros(F.unix_micros("event_timestamp") + F.lit(shift * 1_000_000)),
                before_seconds=0, after_seconds=width)
            for shift in (join.min_seconds, -join.max_seconds))
        ids = after.unionByName(before).distinct()
    elif join.max_seconds is not None:
        ids = ids_of(before_seconds=join.max_seconds, after_seconds=join.max_seconds)
    else:
        ids = ids_of()
    return with_match(primary, ids) if join.relation == "EXISTS" else without_match(primary, ids)
