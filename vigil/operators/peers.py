"""Peer benchmarking: five metrics per entity, cohorts with fallback, z-scores and percentile ranks.

Rows here are entities (supervised organisations), a small dimension, after one aggregation over the
event table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import clamp, first_of, hours_between, seconds_between
from vigil.functions.stats import z_score
from vigil.operators.absence import entity_counters, jewel_assets, unmatched_assets
from vigil.operators.ranking import exact_percentiles, value_ranks
from vigil.operators.temporal import key_array
from vigil.schema import of_type
from vigil.session import cut_lineage

METRICS = (
    "mtti_minutes",
    "escalation_rate",
    "stale_case_ratio",
    "coverage_gap_ratio",
    "execution_gap_rate",
)
STALE_STATUSES = ("OPEN", "IN_PROGRESS", "ACTIVE")  # fixed values
COHORT_JEWEL_TIERS = ("CROWN_JEWEL", "CRITICAL", "TIER_1")  # fixed values

# Reference mean and standard deviation per sector, in the order of METRICS.
BASELINES = {
    "Banking": ((30.0, 15.0), (0.08, 0.03), (0.05, 0.02), (0.02, 0.01), (2.0, 1.0)),
    "Telecom": ((45.0, 20.0), (0.06, 0.025), (0.08, 0.03), (0.05, 0.02), (3.5, 1.5)),
    "Energy": ((60.0, 25.0), (0.05, 0.02), (0.10, 0.04), (0.04, 0.02), (4.0, 2.0)),
    "Healthcare": ((50.0, 22.0), (0.07, 0.03), (0.09, 0.035), (0.06, 0.03), (4.5, 2.0)),
    "DEFAULT": ((45.0, 20.0), (0.07, 0.03), (0.07, 0.03), (0.05, 0.02), (3.0, 1.5)),
}


def baseline_columns(sector: Column | str, metric: Column | str) -> tuple[Column, Column]:
    """(mean, std) of the sector's reference values; unknown sectors use the default row."""
    table = F.create_map(
        *[
            x
            for name, rows in BASELINES.items()
            for m, (mean, std) in zip(METRICS, rows)
            for x in (F.lit(f"{name}|{m}"), F.array(F.lit(mean), F.lit(std)))
        ]
    )
    s = F.col(sector) if isinstance(sector, str) else sector
    m = F.col(metric) if isinstance(metric, str) else metric
    known = F.when(s.isin(*[n for n in BASELINES if n != "DEFAULT"]), s).otherwise(F.lit("DEFAULT"))
    value = table[F.concat_ws("|", known, m)]
    return F.coalesce(value[0], F.lit(50.0)), F.coalesce(value[1], F.lit(15.0))


def time_to_investigate(events: DataFrame) -> DataFrame:
    """Mean minutes from an alert to its first investigation, per entity with any such alert."""
    first_seen = (
        of_type(events, "investigation_records")
        .where(F.col("event_timestamp").isNotNull())
        .select(
            "entity_id", "event_timestamp",
            F.explode(key_array(first_of("alert_id", "raw_ref_id"), "case_id")).alias("ref"),
        )
        .groupBy("entity_id", "ref")
        .agg(F.min("event_timestamp").alias("first_seen"))
    )
    alerts = (
        of_type(events, "alert_metadata")
        .where(F.col("event_timestamp").isNotNull())
        .select("entity_id", "event_timestamp", first_of("raw_ref_id", "alert_id").alias("ref"))
    )
    minutes = F.greatest(F.lit(0.0), seconds_between("first_seen", "event_timestamp") / 60.0)
    return alerts.join(first_seen, ["entity_id", "ref"]).groupBy("entity_id").agg(
        F.avg(minutes).alias("mtti")
    )


def stale_open_cases(events: DataFrame, as_of: datetime, parity: bool = False) -> DataFrame:
    """Open cases older than 72 hours per entity; with `parity` every open case counts as stale."""
    age = hours_between(F.lit(as_of).cast("timestamp"), "event_timestamp")
    stale = F.lit(True) if parity else (F.col("event_timestamp").isNull() | (age > 72.0))
    return (
        of_type(events, "case_management")
        .where(F.upper("status").isin(*STALE_STATUSES))
        .groupBy("entity_id")
        .agg(F.count_if(stale).alias("stale"))
    )


def coverage_gaps(events: DataFrame) -> DataFrame:
    """(entity, jewels, unmonitored): critical assets without a coverage report of at least 50% uptime."""
    jewels = jewel_assets(events, COHORT_JEWEL_TIERS)
    covered = (
        of_type(events, "coverage_reports")
        .where(F.coalesce("uptime_pct", F.lit(100.0)) >= 50.0)
        .select("entity_id", first_of("asset_id", "raw_ref_id").alias("asset"))
        .where(F.col("asset").isNotNull())
        .distinct()
    )
    total = jewels.groupBy("entity_id").agg(F.count("*").alias("jewels"))
    missing = unmatched_assets(jewels, covered).groupBy("entity_id").agg(F.count("*").alias("unmonitored"))
    return total.join(missing, "entity_id", "left").withColumn("unmonitored", F.coalesce("unmonitored", F.lit(0)))


def entity_metrics(
    entities: DataFrame,
    events: DataFrame,
    findings: DataFrame | None,
    as_of: datetime,
    parity: bool = False,
) -> DataFrame:
    """One snapshot row per entity with the five metrics."""
    counts = entity_counters(
        of_type(events, "alert_metadata", "case_management", "escalation_records")
    ).select("entity_id", "alerts", "cases", "escalations")
    spent = of_type(events, "investigation_records").groupBy("entity_id").agg(
        F.avg("time_spent_minutes").alias("spent")
    )
    df = (
        entities.select("entity_id", "sector", "size_tier")
        .join(counts, "entity_id", "left")
        .join(time_to_investigate(events), "entity_id", "left")
        .join(spent, "entity_id", "left")
        .join(stale_open_cases(events, as_of, parity), "entity_id", "left")
        .join(coverage_gaps(events), "entity_id", "left")
    )
    if findings is not None:
        df = df.join(findings.groupBy("entity_id").agg(F.count("*").alias("gaps")), "entity_id", "left")
    else:
        df = df.withColumn("gaps", F.lit(0))
    df = df.na.fill(0, ["alerts", "cases", "escalations", "stale", "jewels", "unmonitored", "gaps"])

    def per(n: str, *of: str) -> Column:
        return F.col(n) / F.greatest(*[F.col(o) for o in of], F.lit(1), F.lit(1))

    return df.select(
        "entity_id", "sector", "size_tier",
        F.round(F.coalesce("mtti", "spent", F.lit(45.0)), 2).alias("mtti_minutes"),
        F.round(per("escalations", "alerts"), 4).alias("escalation_rate"),
        F.round(per("stale", "cases"), 4).alias("stale_case_ratio"),
        F.round(per("unmonitored", "jewels"), 4).alias("coverage_gap_ratio"),
        F.round(F.least(F.lit(100.0), per("gaps", "cases", "alerts") * 100.0), 2).alias("execution_gap_rate"),
        F.col("alerts").alias("total_alerts"),
        F.col("cases").alias("total_cases"),
        F.col("jewels").alias("total_crown_jewels"),
    )


PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def cohort_distribution(df: DataFrame, keys: list[str], value: str, ranks: DataFrame | None = None) -> DataFrame:
    """Sample mean, standard deviation (floor 1e-4) and linear percentiles per group.

    `ranks` are the group's value ranks, where the caller has them already.
    """
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    points = exact_percentiles(value_ranks(df, keys, value) if ranks is None else ranks, keys, PERCENTILES)
    return stats.join(points, keys).select(
        *keys, "n",
        F.round("mean", 4).alias("mean_val"),
        F.round(F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-4)), 4).alias("std_dev"),
        *[F.round(name, 4).alias(name) for name in PERCENTILES],
    )


def choose_cohorts(metrics: DataFrame, min_peers: int = 3, dampening: float = 0.5) -> DataFrame:
    """Cohort of each entity: exact, else sector, else everyone, else the reference baseline."""
    sector, tier = F.lower("sector"), F.lower("size_tier")
    counted = metrics.withColumn("n_exact", F.count("*").over(W.partitionBy(sector, tier))).withColumn(
        "n_sector", F.count("*").over(W.partitionBy(sector))
    )
    total = metrics.agg(F.count("*").alias("n_all"))
    counted = counted.join(F.broadcast(total))  # one row
    exact = F.col("n_exact") >= min_peers
    by_sector = F.col("n_sector") >= min_peers
    everyone = F.col("n_all") >= min_peers

    def pick(a, b, c, d) -> Column:
        return F.when(exact, a).when(by_sector, b).when(everyone, c).otherwise(d)

    def key(level: str, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(level), *parts)

    return counted.select(
        *metrics.columns,
        pick(F.lit("EXACT_COHORT"), F.lit("SECTOR_FALLBACK"), F.lit("GLOBAL_FALLBACK"), F.lit("BASELINE_FALLBACK")).alias("fallback_applied"),
        pick(key("exact", sector, tier), key("sector", sector), key("all"), key("all")).alias("cohort"),
        pick(F.col("n_exact"), F.col("n_sector"), F.col("n_all"), F.col("n_all")).alias("peer_group_size"),
        (~exact).alias("is_low_confidence"),
        F.when(exact, F.lit(1.0)).otherwise(F.lit(dampening)).alias("dampening_factor"),
    )


def long_metrics(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.unpivot(keep, list(METRICS), "metric_name", "value")


def cohort_members(metrics: DataFrame) -> DataFrame:
    """Every entity under each cohort it can belong to, in long form."""
    sector, tier = F.lower("sector"), F.lower("size_tier")
    cohorts = F.array(
        F.concat_ws("|", F.lit("exact"), sector, tier),
        F.concat_ws("|", F.lit("sector"), sector),
        F.lit("all"),
    )
    return long_metrics(metrics.withColumn("cohort", F.explode(cohorts)), ["entity_id", "cohort"])


def percentile_ranks(
    values: DataFrame, keys: list[str], value: str = "value", ranks: DataFrame | None = None
) -> DataFrame:
    """Mid-rank percentile of each distinct value per group: (below + close / 2) / n * 100.

    Two values are close within 1e-5 relative or absolute.  Close values are found by an equi join on
    neighbouring buckets of a scale on which closeness has constant width, so the work is linear.
    """
    tolerance = 1e-5
    size = F.abs("v")
    scale = F.signum("v") * F.when(size <= 1.0, size).otherwise(1.0 + F.ln(size))
    ranked = (value_ranks(values, keys, value) if ranks is None else ranks).withColumn(
        "bucket", F.floor(scale / (2 * tolerance)).cast("bigint")
    )
    near = ranked.select(
        *keys, F.col("v").alias("x"), F.col("c").alias("xc"),
        F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"),
    )
    close = F.abs(F.col("v") - F.col("x")) <= F.greatest(
        tolerance * F.greatest(F.abs("v"), F.abs("x")), F.lit(tolerance)
    )
    return (
        ranked.join(near, [*keys, "bucket"])
        .groupBy(*keys, "v")
        .agg(
            F.first("below").alias("below"), F.first("n").alias("n"),
            F.sum(F.when(close, F.col("xc")).otherwise(0)).alias("close"),
        )
        .select(
            *keys, F.col("v").alias(value),
            F.round(clamp((F.col("below") + 0.5 * F.col("close")) / F.col("n") * 100.0, 0.0, 100.0), 2).alias("percentile"),
        )
    )


def benchmark_entities(
    metrics: DataFrame, min_peers: int = 3, dampening: float = 0.5
) -> DataFrame:
    """Per entity and metric: the cohort's distribution, z-score and percentile rank.

    The snapshot rows are read several times from here on and stand for a pass over all events, so
    they are stored first.
    """
    metrics = cut_lineage(metrics)
    members = cohort_members(metrics)
    keys = ["cohort", "metric_name"]
    positions = value_ranks(members, keys, "value")
    stats = cohort_distribution(members, keys, "value", positions).drop("n")
    ranks = percentile_ranks(members, keys, ranks=positions)
    chosen = choose_cohorts(metrics, min_peers, dampening)
    rows = long_metrics(
        chosen,
        ["entity_id", "sector", "size_tier", "fallback_applied", "cohort", "peer_group_size", "is_low_confidence", "dampening_factor"],
    ).join(stats, ["cohort", "metric_name"]).join(ranks, ["cohort", "metric_name", "value"])
    base_mean, base_std = baseline_columns("sector", "metric_name")
    use_base = (F.col("fallback_applied") == "BASELINE_FALLBACK") | (F.col("peer_group_size") < 2)

    def stat(name: str, baseline: Column) -> Column:
        return F.when(use_base, baseline).otherwise(F.col(name)).alias(name)

    rows = rows.withColumn("base_mean", base_mean).withColumn("base_std", base_std).select(
        "entity_id", "sector", "size_tier", "metric_name", "value", "fallback_applied",
        "peer_group_size", "is_low_confidence", "dampening_factor",
        # a lone entity is ranked against the baseline mean
        F.when(
            F.col("peer_group_size") < 2,
            F.when(F.col("value") > F.col("base_mean"), 100.0).when(F.col("value") < F.col("base_mean"), 0.0).otherwise(50.0),
        ).otherwise(F.col("percentile")).alias("percentile"),
        stat("mean_val", F.col("base_mean")),
        stat("std_dev", F.col("base_std")),
        stat("p25", F.col("base_mean") - 0.67 * F.col("base_std")),
        stat("p50", F.col("base_mean")),
        stat("p75", F.col("base_mean") + 0.67 * F.col("base_std")),
        stat("p90", F.col("base_mean") + 1.28 * F.col("base_std")),
    )
    return rows.withColumn("z_score", z_score("value", "mean_val", "std_dev"))


def peer_evaluations(benchmarks: DataFrame) -> DataFrame:
    """Peer deviation score per entity; a low escalation rate is the risky direction."""
    risk_z = F.when(F.col("metric_name") == "escalation_rate", -F.col("z_score")).otherwise(F.col("z_score"))
    keys = ["entity_id", "sector", "size_tier", "fallback_applied", "peer_group_size", "is_low_confidence", "dampening_factor"]
    pair = F.struct("metric_name", "z_score")
    rank = F.struct("metric_name", "percentile")
    return (
        benchmarks.groupBy(*keys)
        .agg(
            F.avg(clamp(risk_z, -3.5, 3.5)).alias("mean_z"),
            F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("metric_z_scores"),
            F.map_from_entries(F.array_sort(F.collect_list(rank))).alias("metric_percentiles"),
        )
        .select(
            *keys, "metric_z_scores", "metric_percentiles",
            F.round("mean_z", 4).alias("mean_risk_z_score"),
            clamp(F.round(50.0 + 25.0 * F.col("mean_z") * F.col("dampening_factor"), 2), 0.0, 100.0).alias("peer_deviation_score"),
        )
    )


def cohort_benchmarks(benchmarks: DataFrame, period_start: Column, period_end: Column) -> DataFrame:
    """Benchmark table: one row per (sector, size tier, metric)."""
    return benchmarks.dropDuplicates(["sector", "size_tier", "metric_name"]).select(
        "sector", "size_tier", "metric_name",
        period_start.alias("period_start"), period_end.alias("period_end"),
        "peer_group_size", "mean_val", "std_dev", "p25", "p50", "p75", "p90",
        "is_low_confidence", F.col("fallback_applied").alias("fallback_level"),
    )
