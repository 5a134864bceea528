"""Absence checks NS-01..08 and the statistics they rest on, over all entities at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import first_of, non_blank, seconds_between, severity_of_score, stable_id
from vigil.functions.stats import entropy_from, ewma, sample_weight
from vigil.functions.timestamps import is_weekend
from vigil.operators.execution_gaps import Period
from vigil.operators.rules import Check, Registry, check_registry
from vigil.schema import CLOSED_STATUSES, event_order, is_high, of_type
from vigil.session import cut_lineage

JEWEL_TIERS = ("CROWN_JEWEL", "CRITICAL", "TIER_1", "TIER-1")  # fixed values
EVIDENCE_LIMIT = 20
#: Entities with a finding, up to which they choose its evidence by a broadcast.
BROADCAST_ENTITIES = 200_000


# --- statistics -----------------------------------------------------------------------------------


def entity_counters(events: DataFrame) -> DataFrame:
    """All conditional counts per entity in one pass with map-side combining."""
    kind = F.col("dataset_type")
    alert, case = kind == "alert_metadata", kind == "case_management"
    weekend = F.coalesce(is_weekend("event_timestamp"), F.lit(False))
    closed = F.coalesce(F.upper("status").isin(*CLOSED_STATUSES), F.lit(False))
    return events.groupBy("entity_id").agg(
        F.count("*").alias("events"),
        F.count_if(alert).alias("alerts"),
        F.count_if(alert & weekend).alias("weekend_alerts"),
        F.count_if((kind == "analyst_activity") & weekend).alias("weekend_activities"),
        F.count_if(alert & is_high()).alias("high_alerts"),
        F.count_if(kind == "escalation_records").alias("escalations"),
        F.count_if(case).alias("cases"),
        F.count_if(case & closed).alias("closed_cases"),
    )


def daily_volume(events: DataFrame, zero_fill: bool = False) -> DataFrame:
    """(entity, day, volume); optionally with the silent days between the first and last day."""
    volume = (
        events.where(F.col("event_timestamp").isNotNull())
        .groupBy("entity_id", F.to_date("event_timestamp").alias("day"))
        .agg(F.count("*").alias("volume"))
    )
    if not zero_fill:
        return volume
    # days are a calendar-sized set per entity
    last_day = volume.agg(F.max("day").alias("last_day"))
    days = (
        volume.groupBy("entity_id").agg(F.min("day").alias("first_day"))
        .join(F.broadcast(last_day))
        .select("entity_id", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    )
    return days.join(volume, ["entity_id", "day"], "left").withColumn(
        "volume", F.coalesce("volume", F.lit(0))
    )


def volume_cliffs(
    events: DataFrame, alpha: float = 0.20, k: float = 3.0, min_days: int = 5, zero_fill: bool = False
) -> DataFrame:
    """EWMA baseline of the history against the latest day, one row per entity with enough days."""
    series = (
        daily_volume(events, zero_fill)
        .groupBy("entity_id")
        # one entry per calendar day
        .agg(F.array_sort(F.collect_list(F.struct("day", F.col("volume").cast("double").alias("v")))).alias("s"))
        .where(F.size("s") >= min_days)
        .select(
            "entity_id",
            F.element_at("s", -1)["day"].alias("latest_day"),
            F.element_at("s", -1)["v"].alias("latest"),
            (F.size("s") - 1).alias("history_days"),
            ewma(F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda x: x["v"]), alpha).alias("b"),
        )
    )
    threshold = F.col("b.mu") - k * F.col("b.sigma")
    drop = F.when(
        F.col("b.mu") > 0, F.greatest(F.lit(0.0), (F.col("b.mu") - F.col("latest")) / F.col("b.mu") * 100.0)
    ).otherwise(F.lit(0.0))
    cliff = (F.col("latest") < threshold) | ((F.col("b.mu") >= 10.0) & (drop >= 60.0))
    return series.select(
        "entity_id", "latest_day", "history_days",
        F.round("b.mu", 2).alias("expected_volume"),
        F.round("latest", 2).alias("observed_volume"),
        F.round("b.sigma", 2).alias("sigma"),
        F.round(drop, 2).alias("drop_percentage"),
        F.round(threshold, 2).alias("cliff_threshold"),
        cliff.alias("is_finding"),
    )


def category_entropy(rows: DataFrame, category: Column | str) -> DataFrame:
    """Shannon entropy of a category per entity: entropy, maximum, sample size, distinct values."""
    label = F.col(category) if isinstance(category, str) else category
    counts = (
        rows.select("entity_id", label.alias("category"))
        .where(non_blank("category").isNotNull())
        .groupBy("entity_id", "category").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("entity_id").agg(
        F.sum("n").alias("samples"),
        F.count("*").alias("categories"),
        F.sum(F.col("n") * F.log2("n")).alias("s"),
    )
    several = F.col("categories") > 1
    return totals.select(
        "entity_id", "samples", "categories",
        F.when(several, F.round(entropy_from(F.col("samples"), F.col("s")), 4)).otherwise(F.lit(0.0)).alias("entropy"),
        F.when(several, F.round(F.log2("categories"), 4)).otherwise(F.lit(0.0)).alias("max_entropy"),
    )


def inter_arrival(rows: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Coefficient of variation of the gaps between successive timestamps, per entity.

    No entity's rows are ordered in one task.  Equal timestamps are counted first (their gaps are
    zero), the rest is differenced inside hourly slices, and the gaps between slices come from one
    (first, last) row per slice.  Sums are exact integers in microseconds, so the result does not
    depend on the order of partial sums.
    """
    big = "decimal(38,0)"
    ticks = (
        rows.where(F.col("event_timestamp").isNotNull())
        .groupBy("entity_id", F.unix_micros("event_timestamp").alias("t"))
        .agg(F.count("*").alias("copies"))
        .withColumn("slice", F.floor(F.col("t") / F.lit(slice_seconds * 1_000_000)).cast("bigint"))
    )
    inside = W.partitionBy("entity_id", "slice").orderBy("t")
    slices = (
        ticks.withColumn("gap", (F.col("t") - F.lag("t").over(inside)).cast(big))
        .groupBy("entity_id", "slice")
        .agg(
            F.sum("copies").alias("n"),
            F.min("t").alias("first"),
            F.max("t").alias("last"),
            F.sum(F.col("gap") * F.col("gap")).cast(big).alias("squares"),
        )
    )
    between = (F.col("first") - F.lag("last").over(W.partitionBy("entity_id").orderBy("slice"))).cast(big)
    totals = (
        slices.withColumn("gap", between)
        .groupBy("entity_id")
        .agg(
            F.sum("n").alias("samples"),
            (F.max("last") - F.min("first")).cast(big).alias("span"),
            (
                F.coalesce(F.sum("squares"), F.lit(0).cast(big))
                + F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0).cast(big))
            ).cast(big).alias("squares"),
        )
        .withColumn("m", F.when(F.col("samples") > 1, (F.col("samples") - 1).cast(big)))
    )
    # sum of squared deviations without cancellation: span = q*m + r, so
    # squares - span^2/m = (squares - m*q^2 - 2*q*r) - r^2/m, whose first part is an exact integer
    stats = (
        totals.withColumn("q", F.expr("span div m").cast(big))
        .withColumn("r", F.col("span") - F.col("q") * F.col("m"))
        .withColumn(
            "deviations",
            (F.col("squares") - F.col("m") * F.col("q") * F.col("q") - 2 * F.col("q") * F.col("r")).cast("double")
            - F.col("r").cast("double") * F.col("r").cast("double") / F.col("m").cast("double"),
        )
        .withColumn("mean", F.col("span").cast("double") / F.col("m").cast("double") / 1e6)
        .withColumn(
            "std",
            F.when(
                F.col("m") > 1,
                F.sqrt(F.greatest(F.lit(0.0), F.col("deviations")) / (F.col("m").cast("double") - 1)) / 1e6,
            ).otherwise(F.lit(0.0)),
        )
    )
    enough = F.col("samples") >= 2
    return stats.select(
        "entity_id", "samples",
        F.when(~enough, F.lit(1.0)).when(F.col("mean") <= 0, F.lit(0.0))
        .otherwise(F.round(F.col("std") / F.col("mean"), 5)).alias("cv"),
        F.when(enough, F.round("mean", 2)).otherwise(F.lit(0.0)).alias("mean_seconds"),
        F.when(enough, F.round("std", 2)).otherwise(F.lit(0.0)).alias("std_seconds"),
    )


def _counters(counters: DataFrame | None, events: DataFrame, *types: str) -> DataFrame:
    """Counters handed over by the caller, else those of the dataset types that are asked for."""
    return entity_counters(of_type(events, *types)) if counters is None else counters


# --- findings -------------------------------------------------------------------------------------


def leading_evidence(rows: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """First `limit` event ids per entity in time order; ranks are cut before the shuffle."""
    ranked = rows.where(non_blank("event_id").isNotNull()).withColumn(
        "rank", F.row_number().over(W.partitionBy("entity_id").orderBy(event_order()))
    )
    return (
        ranked.where(F.col("rank") <= limit)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "event_id"))).alias("e"))
        .select("entity_id", F.transform("e", lambda x: x["event_id"]).alias("evidence"))
    )


def rows_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose values are in `found` (checkpointed, a row for each entity at most), chosen before they are moved or sorted."""
    few = F.broadcast(found) if found.count() <= BROADCAST_ENTITIES else found
    return rows.join(few, found.columns, "left_semi")


def _with_evidence(hits: DataFrame, rows: DataFrame) -> DataFrame:
    hits = cut_lineage(hits)
    return hits.join(leading_evidence(rows_of(rows, hits.select("entity_id"))), ["entity_id"], "left")


def absence_finding(
    df: DataFrame,
    check: Check,
    period: Period,
    *,
    score: Column | int,
    expected: Column,
    observed: Column,
    drop: Column,
    rationale: Column,
    severity: str | None = None,
    entropy: Column | None = None,
    weight: Column | None = None,
    subject: Column | None = None,
    evidence: Column | None = None,
    evidence_count: Column | None = None,
    refs: Column | None = None,
    metrics: Column | None = None,
) -> DataFrame:
    start, end = period.columns()
    score_column = (F.lit(score) if isinstance(score, int) else score).cast("int")
    ids = F.coalesce(F.col("evidence") if evidence is None else evidence, F.array().cast("array<string>"))
    factor = F.lit(1.0) if weight is None else weight
    return df.select(
        stable_id(F.lit(check.code), F.col("entity_id"), F.lit("") if subject is None else subject, start, end).alias("finding_id"),
        "entity_id",
        F.lit(check.code).alias("check_id"),
        F.lit(check.name).alias("check_name"),
        F.lit(check.category).alias("check_category"),
        (severity_of_score(score_column) if severity is None else F.lit(severity)).alias("severity"),
        score_column.alias("severity_score"),
        F.lit(float(check.confidence)).alias("confidence"),
        start.alias("period_start"),
        end.alias("period_end"),
        expected.cast("double").alias("expected_volume"),
        observed.cast("double").alias("observed_volume"),
        drop.cast("double").alias("drop_percentage"),
        (F.lit(None) if entropy is None else entropy).cast("double").alias("entropy_score"),
        rationale.alias("rationale"),
        ids.alias("evidence_record_ids"),
        (F.size(ids) if evidence_count is None else evidence_count).cast("bigint").alias("evidence_count"),
        (F.array() if refs is None else refs).cast("array<string>").alias("raw_evidence_refs"),
        (F.create_map() if metrics is None else metrics).cast("map<string,string>").alias("metric_values"),
        (F.lit(False) if weight is None else (factor < 1.0)).alias("is_degraded"),
        factor.alias("degradation_factor"),
        F.lit(check.recommendation).cast("string").alias("recommendation"),
    )


def _weighted(check: Check, n: Column) -> tuple[Column, Column]:
    weight = sample_weight(n, check.min_sample)
    return weight, F.round(check.severity_base * weight).cast("int")


def _low_sample_note(weight: Column, n: Column) -> Column:
    return F.when(
        weight < 1.0,
        F.format_string(" [LOW SAMPLE WARNING: Based on N=%s events, baseline confidence dampened].", n),
    ).otherwise(F.lit(""))


def volume_cliff_findings(
    events: DataFrame, check: Check, period: Period, counters: DataFrame | None = None, **params
) -> DataFrame:
    """NS-01: the latest day falls off the EWMA baseline."""
    counted = entity_counters(events) if counters is None else counters
    samples = counted.select("entity_id", F.col("events").alias("n"))
    hits = cut_lineage(volume_cliffs(events, **params).where("is_finding").join(samples, ["entity_id"]))
    rows = rows_of(
        events.withColumn("day", F.to_date("event_timestamp")), hits.select("entity_id", F.col("latest_day").alias("day")))
    df = hits.join(leading_evidence(rows), ["entity_id"], "left")
    weight, score = _weighted(check, F.col("n"))
    rationale = F.concat(
        F.format_string(
            "Daily telemetry volume dropped from expected baseline of %s to %s (%s%% reduction, "
            "exceeding 3-sigma cliff threshold of %s).",
            "expected_volume", "observed_volume", "drop_percentage", "cliff_threshold",
        ),
        _low_sample_note(weight, F.col("n")),
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=F.col("expected_volume"), observed=F.col("observed_volume"), drop=F.col("drop_percentage"),
    )


def weekend_silence(
    events: DataFrame, check: Check, period: Period, min_alerts: int = 20, counters: DataFrame | None = None
) -> DataFrame:
    """NS-02: weekend alerts without any weekend analyst activity."""
    hits = _counters(counters, events, "alert_metadata", "analyst_activity").where(
        (F.col("weekend_alerts") >= min_alerts) & (F.col("weekend_activities") == 0)
    )
    rows = of_type(events, "alert_metadata").where(is_weekend("event_timestamp"))
    df = _with_evidence(hits, rows)
    n = F.col("weekend_alerts")
    weight, score = _weighted(check, n)
    rationale = F.concat(
        F.format_string(
            "During weekend evaluation period, %s security alerts fired with 0 analyst console activity "
            "or triage audit logs.", n,
        ),
        _low_sample_note(weight, n),
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=n, observed=F.lit(0.0), drop=F.lit(100.0),
    )


def jewel_assets(events: DataFrame, tiers: tuple[str, ...] = JEWEL_TIERS) -> DataFrame:
    return (
        of_type(events, "asset_inventory")
        .where(F.upper("criticality_tier").isin(*tiers))
        .select(
            "entity_id", "event_id", "hostname", "raw_row_index", "event_timestamp",
            first_of("asset_id", "raw_ref_id").alias("asset_key"),
            first_of("asset_id", "hostname").alias("asset_ref"),
        )
    )


def telemetry_assets(events: DataFrame) -> DataFrame:
    """Distinct (entity, asset) seen in coverage reports or alerts."""
    coverage = of_type(events, "coverage_reports").select(
        "entity_id", first_of("asset_id", "raw_ref_id").alias("asset")
    )
    alerts = of_type(events, "alert_metadata").select("entity_id", non_blank("asset_id").alias("asset"))
    return coverage.unionByName(alerts).where(F.col("asset").isNotNull()).distinct()


def unmatched_assets(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """Assets known neither by key nor by host name."""
    by_key = seen.withColumnRenamed("asset", "asset_key")
    by_host = seen.withColumnRenamed("asset", "hostname")
    return assets.join(by_key, ["entity_id", "asset_key"], "left_anti").join(
        by_host, ["entity_id", "hostname"], "left_anti"
    )


def silent_jewels(events: DataFrame) -> DataFrame:
    """Long-form evidence of NS-03: every critical asset without telemetry."""
    return unmatched_assets(jewel_assets(events), telemetry_assets(events))


def uncovered_jewels(events: DataFrame, check: Check, period: Period) -> DataFrame:
    """NS-03: critical assets in neither coverage reports nor alerts; one finding per entity."""
    totals = jewel_assets(events).groupBy("entity_id").agg(F.count("*").alias("total"))
    silent = silent_jewels(events)
    counts = silent.groupBy("entity_id").agg(F.count("*").alias("silent"))
    # an entity's inventory of critical assets bounds its list
    first = (
        silent.groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct(event_order().alias("o"), "event_id", "asset_ref"))).alias("f"))
        .select(
            "entity_id",
            F.array_compact(F.transform("f", lambda x: x["event_id"])).alias("evidence"),
            F.array_compact(F.transform("f", lambda x: x["asset_ref"])).alias("refs"),
        )
    )
    df = totals.join(counts, ["entity_id"]).join(first, ["entity_id"])
    rationale = F.format_string(
        "%s out of %s Tier-1 Critical assets (%s) exhibit total telemetry silence and lack active "
        "EDR/WAF/NDR logs.",
        F.col("silent"), F.col("total"), F.array_join(F.slice("refs", 1, 5), ", "),
    )
    return absence_finding(
        df, check, period, score=check.severity_base, severity="CRITICAL",
        expected=F.col("total"), observed=F.col("total") - F.col("silent"),
        drop=F.round(F.col("silent") / F.col("total") * 100.0, 1),
        rationale=rationale, refs=F.col("refs"), evidence_count=F.col("silent"),
        metrics=F.create_map(
            F.lit("unmonitored_count"), F.col("silent").cast("string"),
            F.lit("total_critical_assets"), F.col("total").cast("string"),
        ),
    )


def closure_deficit(
    events: DataFrame, check: Check, period: Period, min_cases: int = 30, limit: float = 10.0,
    counters: DataFrame | None = None,
) -> DataFrame:
    """NS-04: fewer than 10% of at least 30 cases closed."""
    rows = of_type(events, "case_management")
    rate = F.round(F.col("closed_cases") / F.col("cases") * 100.0, 1)
    hits = _counters(counters, events, "case_management").where(F.col("cases") >= min_cases).withColumn(
        "rate", rate
    ).where(F.col("rate") < limit)
    df = _with_evidence(hits, rows)
    n = F.col("cases")
    weight, score = _weighted(check, n)
    rationale = F.concat(
        F.format_string(
            "Over the evaluation period, %s cases were opened but only %s were resolved "
            "(closure rate %s%% < 10%% threshold).", n, F.col("closed_cases"), F.col("rate"),
        ),
        _low_sample_note(weight, n),
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=n, observed=F.col("closed_cases"), drop=F.round(100.0 - F.col("rate"), 1),
    )


def surge_without_escalation(
    events: DataFrame, check: Check, period: Period, min_alerts: int = 20, counters: DataFrame | None = None
) -> DataFrame:
    """NS-05: at least 20 critical or high alerts and not one escalation."""
    hits = _counters(counters, events, "alert_metadata", "escalation_records").where(
        (F.col("high_alerts") >= min_alerts) & (F.col("escalations") == 0)
    )
    df = _with_evidence(hits, of_type(events, "alert_metadata").where(is_high()))
    n = F.col("high_alerts")
    weight, score = _weighted(check, n)
    rationale = F.concat(
        F.format_string(
            "A surge of %s High/Critical priority alerts occurred during the evaluation window with zero "
            "escalations to Tier-2/Tier-3 IR teams.", n,
        ),
        _low_sample_note(weight, n),
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=n, observed=F.lit(0.0), drop=F.lit(100.0),
    )


def rule_label() -> Column:
    return first_of("rule_id", "alert_name", "action")


def rule_monoculture(events: DataFrame, check: Check, period: Period, min_alerts: int = 50, limit: float = 0.5) -> DataFrame:
    """NS-06: entropy of the alert rules below half a bit."""
    rows = of_type(events, "alert_metadata")
    hits = category_entropy(rows, rule_label()).where(
        (F.col("samples") >= min_alerts) & (F.col("entropy") < limit)
    )
    df = _with_evidence(hits, rows)
    weight, score = _weighted(check, F.col("samples"))
    rationale = F.format_string(
        "Categorical alert rule distribution exhibits abnormally low Shannon entropy H(X) = %s bits "
        "(< 0.50 bits threshold across N=%s alerts and M=%s rules), indicating sensor blindness on other "
        "attack vectors.", "entropy", "samples", "categories",
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=F.col("max_entropy"), observed=F.col("entropy"), entropy=F.col("entropy"),
        drop=F.round((1.0 - F.col("entropy") / F.greatest(F.lit(0.1), F.col("max_entropy"))) * 100.0, 1),
    )


def synthetic_heartbeat(events: DataFrame, check: Check, period: Period, min_alerts: int = 20, limit: float = 0.01) -> DataFrame:
    """NS-07: alert intervals that hardly vary."""
    rows = of_type(events, "alert_metadata")
    hits = inter_arrival(rows).where((F.col("samples") >= min_alerts) & (F.col("cv") < limit))
    df = _with_evidence(hits, rows)
    weight, score = _weighted(check, F.col("samples"))
    rationale = F.format_string(
        "Alert inter-arrival times exhibit near-zero variance (CV = %s < 0.01 threshold, mean delta %ss, "
        "sigma %ss across N=%s alerts), indicating synthetic heartbeat or mock telemetry.",
        "cv", "mean_seconds", "std_seconds", "samples",
    )
    return absence_finding(
        df, check, period, score=score, weight=weight, rationale=rationale,
        expected=F.lit(1.0), observed=F.col("cv"), drop=F.round((1.0 - F.col("cv")) * 100.0, 1),
    )


def untraced_incidents(events: DataFrame, check: Check, period: Period, min_days: float = 14.0) -> DataFrame:
    """NS-08: incidents resolved over 14 days ago with no later coverage or activity.

    "Some later record exists" is a comparison with the latest record of the entity.
    """
    _, end = period.columns()
    latest = of_type(events, "coverage_reports", "analyst_activity").groupBy("entity_id").agg(
        F.max("event_timestamp").alias("latest")
    )
    incidents = of_type(events, "incident_reports").select(
        "entity_id", "event_id",
        text_ref().alias("ref"),
        F.coalesce("resolved_at", "event_timestamp", "declared_at").alias("resolved"),
    ).withColumn("days", seconds_between(end, "resolved") / 86400.0).where(F.col("days") > min_days)
    hits = incidents.join(latest, ["entity_id"], "left").where(
        F.col("latest").isNull() | (F.col("latest") <= F.col("resolved"))
    )
    rationale = F.format_string(
        "Critical security incident %s was resolved %s days ago without subsequent coverage telemetry "
        "updates or post-incident audit reviews.", F.col("ref"), F.floor("days").cast("bigint"),
    )
    event = F.coalesce(non_blank("event_id"), F.col("ref"))
    return absence_finding(
        hits, check, period, score=check.severity_base, severity="MEDIUM", subject=event,
        expected=F.lit(1.0), observed=F.lit(0.0), drop=F.lit(100.0), rationale=rationale,
        evidence=F.array(event),
    )


def text_ref() -> Column:
    return first_of("raw_ref_id", "incident_id", F.lit("Incident"))


BUILTIN = {
    "NS-01": volume_cliff_findings,
    "NS-02": weekend_silence,
    "NS-03": uncovered_jewels,
    "NS-04": closure_deficit,
    "NS-05": surge_without_escalation,
    "NS-06": rule_monoculture,
    "NS-07": synthetic_heartbeat,
    "NS-08": untraced_incidents,
}


def evaluate_checks(events: DataFrame, period: Period, registry: Registry | None = None) -> DataFrame:
    """Findings of all active checks."""
    checks = (registry or check_registry()).list()
    if not checks:
        raise ValueError("no active checks")
    counters = cut_lineage(entity_counters(events))  # one row an entity, read by several checks
    shared = {code: {"counters": counters} for code in ("NS-01", "NS-02", "NS-04", "NS-05")}
    return reduce(DataFrame.unionByName, [BUILTIN[c.code](events, c, period, **shared.get(c.code, {})) for c in checks])
