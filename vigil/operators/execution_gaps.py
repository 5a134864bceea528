"""Process-gap rules EG-01..08 and declarative custom rules, over all entities at once.

Each rule maps the canonical event table to finding rows.  Rules filter on the dataset type first
(partition pruning), project the columns they need and keep every join an equi join.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import (
    first_of,
    hours_between,
    non_blank,
    one_decimal,
    seconds_between,
    severity_of_score,
    stable_id,
    text_of,
)
from vigil.functions.timestamps import is_night, is_off_hours, is_weekend
from vigil.operators.conditions import compile_condition
from vigil.operators.rules import Registry, Rule, rule_registry
from vigil.operators.temporal import key_array, matched_ids, temporal_join, without_match
from vigil.schema import CLOSED_STATUSES, event_order, is_high, of_type

# Fixed values.
OPEN_STATUSES = ("OPEN", "IN_PROGRESS", "ACTIVE", "NEW", "UNASSIGNED", "PENDING")
CRITICAL_TIERS = ("CROWN_JEWEL", "CRITICAL", "TIER_1")
SENIOR_TARGETS = ("TIER_3", "TIER-3", "MANAGEMENT", "MANAGER", "CISO", "CERT", "IR", "LEAD", "EXECUTIVE")
GENERIC_NOTES = ("closed", "done", "fp", "resolved", "n/a", "na", "false positive", "ok", "fine", "none")
NO_NOTES = "[NO NOTES RECORDED]"


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime

    def columns(self) -> tuple[Column, Column]:
        return F.lit(self.start).cast("timestamp"), F.lit(self.end).cast("timestamp")


def finding(
    df: DataFrame,
    rule: Rule,
    period: Period,
    *,
    subject: Column,
    score: Column | int,
    severity: Column | str | None = None,
    description: Column,
    rationale: Column,
    evidence: Column,
    refs: Column,
    rows: Column | None = None,
    metrics: dict[str, Column] | None = None,
    evidence_count: Column | None = None,
) -> DataFrame:
    """Project rows to the finding shape. Ids are derived from the subject, so reruns agree."""
    start, end = period.columns()
    score_column = F.lit(score) if isinstance(score, int) else score
    if severity is None:
        severity = severity_of_score(score_column)
    metric_map = (
        F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("string"))])
        if metrics
        else F.create_map().cast("map<string,string>")
    )
    row_list = F.col("raw_row_index") if rows is None else rows
    if rows is None:
        row_list = F.array_compact(F.array(row_list))
    return df.select(
        stable_id(F.lit(rule.code), F.col("entity_id"), subject, start, end).alias("finding_id"),
        "entity_id",
        F.lit(rule.code).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.category).alias("rule_category"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        score_column.cast("int").alias("severity_score"),
        F.lit(float(rule.confidence)).alias("confidence"),
        start.alias("period_start"),
        end.alias("period_end"),
        F.lit("OPEN").alias("status"),
        description.alias("description"),
        rationale.alias("rationale"),
        evidence.cast("array<string>").alias("evidence_record_ids"),
        (F.size(evidence) if evidence_count is None else evidence_count).cast("bigint").alias("evidence_count"),
        refs.cast("array<string>").alias("raw_evidence_refs"),
        row_list.cast("array<bigint>").alias("raw_row_indices"),
        metric_map.cast("map<string,string>").alias("metric_values"),
        F.lit(rule.recommendation).cast("string").alias("recommendation"),
    )


def _event_ref(fallback: Column) -> Column:
    return F.coalesce(non_blank("event_id"), fallback)


def uninvestigated_alerts(events: DataFrame, rule: Rule, period: Period, sla_seconds: int = 7200) -> DataFrame:
    """EG-01: critical or high alerts without an investigation in the two hours after them."""
    alert_key = first_of("raw_ref_id", "alert_id")
    alerts = of_type(events, "alert_metadata").where(is_high()).withColumn("ref", alert_key)
    ids = matched_ids(
        alerts,
        of_type(events, "investigation_records"),
        primary_keys=key_array("ref", "case_id"),
        target_keys=key_array("raw_ref_id", "case_id", "alert_id"),
        before_seconds=0,
        after_seconds=sla_seconds,
    )
    _, end = period.columns()
    open_alerts = without_match(alerts, ids).select(
        "*",
        F.greatest(F.lit(sla_seconds / 3600), hours_between(end, "event_timestamp")).alias("delay"),
        first_of("alert_name", "action", F.lit("Security Alert")).alias("label"),
    )
    # least() before the cast: a decades-long delay must not overflow
    score = F.least(F.lit(100.0), rule.severity_base + 5 * F.floor("delay").cast("double")).cast("int")
    sla = f"{sla_seconds / 3600:g}"
    return finding(
        open_alerts, rule, period,
        subject=_event_ref(F.col("ref")),
        score=score,
        description=F.format_string(
            f"Critical or High severity alert %s (%s) uninvestigated after {sla}-hour SLA.", "ref", "label"
        ),
        rationale=F.format_string(
            f"Alert %s (%s) on asset %s with severity %s received no investigation within the {sla}-hour SLA window.",
            F.col("ref"), F.col("label"), text_of("asset_id", "Unknown Asset"), F.upper("severity"),
        ),
        evidence=F.array(_event_ref(F.col("ref"))),
        refs=F.array("ref"),
        metrics={"delay_hours": F.round("delay", 1), "sla_threshold_hours": F.lit(sla)},
    )


def _is_p1() -> Column:
    priority = F.upper(F.coalesce("priority", F.lit("")))
    return (
        F.contains(priority, F.lit("P1"))
        | F.contains(priority, F.lit("CRITICAL"))
        | F.coalesce(F.upper("severity") == "CRITICAL", F.lit(False))
    )


def escalation_breaches(events: DataFrame, rule: Rule, period: Period, sla_hours: float = 4.0) -> DataFrame:
    """EG-02: P1 cases escalated late (first breach in input order) or never escalated."""
    _, end = period.columns()
    cases = (
        of_type(events, "case_management")
        .where(_is_p1())
        .withColumn("case_key", first_of("raw_ref_id", "case_id"))
        .where(F.col("case_key").isNotNull())
        .select("entity_id", "event_id", "case_key", "raw_row_index", "event_timestamp", "closed_at")
    )
    escalations = (
        of_type(events, "escalation_records")
        .withColumn("case_key", first_of("case_id", "raw_ref_id"))
        .where(F.col("case_key").isNotNull())
        .select(
            "entity_id",
            "case_key",
            F.coalesce("event_timestamp", "escalated_at").alias("esc_time"),
            F.col("escalation_delay_minutes").alias("esc_minutes"),
            F.upper(F.coalesce("escalation_status", F.lit(""))).alias("esc_status"),
            first_of("event_id", "raw_ref_id", F.lit("ESC")).alias("esc_id"),
            event_order().alias("esc_order"),
        )
    )
    # an inner join, so that adaptive skew handling may split either side of a hot case; the
    # per-case reduction afterwards combines map-side
    delay = F.coalesce(
        F.col("esc_minutes") / 60.0,
        F.greatest(F.lit(0.0), hours_between("esc_time", "event_timestamp")),
        F.lit(0.0),
    )
    judged = cases.select("entity_id", "event_id", "case_key", "event_timestamp").join(
        escalations, ["entity_id", "case_key"]
    ).withColumn("delay", delay)
    breach = (F.col("delay") > sla_hours) | (F.col("esc_status") == "BREACHED")
    first_breach = judged.groupBy("entity_id", "event_id").agg(
        F.min_by(F.struct("delay", "esc_status", "esc_id"), F.when(breach, F.col("esc_order"))).alias("first"),
        F.bool_or(breach).alias("breached"),
    )
    checked = cases.join(first_breach, ["entity_id", "event_id"], "left").withColumn(
        "open_hours",
        F.coalesce(
            F.greatest(F.lit(0.0), hours_between(F.coalesce("closed_at", end), "event_timestamp")),
            F.lit(5.0),
        ),
    )
    late = F.col("breached")
    hits = checked.where(
        F.coalesce(late, F.lit(False)) | (late.isNull() & (F.col("open_hours") >= sla_hours))
    ).select(
        "*",
        F.coalesce(late, F.lit(False)).alias("is_late"),
        F.when(late, F.col("first.delay")).otherwise(F.col("open_hours")).alias("hours"),
        F.coalesce(non_blank("first.esc_status"), F.lit("BREACHED")).alias("esc_state"),
    )
    hours = one_decimal(F.round("hours", 1))
    return finding(
        hits, rule, period,
        subject=_event_ref(F.col("case_key")),
        score=rule.severity_base,
        severity="CRITICAL",
        description=F.when(
            F.col("is_late"),
            F.format_string(f"P1 Critical Case %s escalation was delayed (%sh) beyond {sla_hours:g}-hour SLA.", F.col("case_key"), hours),
        ).otherwise(F.format_string(f"P1 Critical Case %s remained unescalated beyond {sla_hours:g}-hour SLA.", "case_key")),
        rationale=F.when(
            F.col("is_late"),
            F.format_string(
                f"P1 Critical Case %s had a delayed escalation exceeding the {sla_hours:g}-hour SLA "
                "(escalation delay: %s hours, status: %s).",
                F.col("case_key"), hours, F.col("esc_state"),
            ),
        ).otherwise(
            F.format_string("P1 Critical Case %s remained unescalated after %s hours of active status.", F.col("case_key"), hours)
        ),
        evidence=F.array_compact(
            F.array(_event_ref(F.col("case_key")), F.when(F.col("is_late"), F.col("first.esc_id")))
        ),
        refs=F.array("case_key"),
        metrics={
            "duration_open_hours": F.round("hours", 1),
            "sla_threshold_hours": F.lit(f"{sla_hours:g}"),
            "escalation_status": F.when(F.col("is_late"), F.col("esc_state")),
        },
    )


def stale_cases(events: DataFrame, rule: Rule, period: Period, idle_limit_hours: float = 72.0) -> DataFrame:
    """EG-03: open cases without any analyst action for more than 72 hours."""
    start, end = period.columns()
    last_action = (
        of_type(events, "analyst_activity", "investigation_records")
        .where(non_blank("case_id").isNotNull() & F.col("event_timestamp").isNotNull())
        .groupBy("entity_id", F.col("case_id").alias("case_key"))
        .agg(F.max("event_timestamp").alias("last_action"))
    )
    cases = (
        of_type(events, "case_management")
        .where(F.upper("status").isin(*OPEN_STATUSES))
        .withColumn("case_key", first_of("raw_ref_id", "case_id"))
        .select("entity_id", "event_id", "case_key", "raw_row_index", "event_timestamp", "resolution_time_hours")
    )
    idle = cases.join(last_action, ["entity_id", "case_key"], "left").withColumn(
        "idle",
        F.greatest(
            F.lit(0.0),
            hours_between(end, F.coalesce("last_action", "event_timestamp", start)),
            F.col("resolution_time_hours"),
        ),
    ).where(F.col("idle") > idle_limit_hours)
    score = F.least(
        F.lit(100.0), rule.severity_base + 5 * F.floor((F.col("idle") - idle_limit_hours) / 24).cast("double")
    ).cast("int")
    days = F.round(F.col("idle") / 24.0, 1)
    return finding(
        idle, rule, period,
        subject=_event_ref(F.col("case_key")),
        score=score,
        description=F.format_string(
            f"Case %s has been dormant/unassigned for over {idle_limit_hours:g} hours without analyst activity.", "case_key"
        ),
        rationale=F.format_string(
            "Case %s has been dormant/unassigned for %s days without any analyst audit trail or notes.",
            F.col("case_key"), one_decimal(days),
        ),
        evidence=F.array(_event_ref(F.col("case_key"))),
        refs=F.array("case_key"),
        metrics={"idle_hours": F.round("idle", 1), "idle_days": days, "threshold_hours": F.lit(f"{idle_limit_hours:g}")},
    )


def _case_investigations(events: DataFrame) -> DataFrame:
    return (
        of_type(events, "investigation_records")
        .withColumn("case_key", first_of("case_id", "raw_ref_id"))
        .where(F.col("case_key").isNotNull())
        .select(
            "entity_id", "case_key", "event_id",
            first_of("investigation_notes", "conclusion").alias("note"),
            event_order().alias("o"),
        )
    )


def closed_without_notes(events: DataFrame, rule: Rule, period: Period, min_length: int = 20) -> DataFrame:
    """EG-04: closed cases whose joined notes are missing, shorter than 20 characters or generic."""
    investigations = _case_investigations(events)
    keys = ["entity_id", "case_key"]
    totals = investigations.groupBy(*keys).agg(
        F.count("note").alias("n_notes"),
        F.bool_or(F.length(F.trim("note")) >= min_length).alias("has_long_note"),
        F.count("*").alias("n_investigations"),
    )
    n_parts = F.coalesce("n_notes", F.lit(0)) + F.when(F.col("own_note").isNotNull(), 1).otherwise(0)
    # one note of 20 characters, or more than 20 notes, always makes the text long enough
    candidates = (
        of_type(events, "case_management")
        .where(F.upper("status").isin(*CLOSED_STATUSES))
        .withColumn("case_key", first_of("raw_ref_id", "case_id"))
        .select(
            "entity_id", "event_id", "case_key", "raw_row_index",
            first_of("notes", "resolution_notes").alias("own_note"),
        )
        .join(totals, keys, "left")
        .withColumn("n_parts", n_parts)
        .where(~F.coalesce("has_long_note", F.lit(False)) & (F.col("n_parts") <= min_length))
    )
    # a candidate has at most 20 notes, none of which has 20 characters besides blanks
    short_notes = (
        investigations.where(F.col("note").isNotNull())
        .join(candidates.where(F.col("n_notes") > 0).select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("o", "note"))).alias("notes"))
    )
    parts = F.concat(
        F.coalesce(F.transform("notes", lambda n: n["note"]), F.array().cast("array<string>")),
        F.array_compact(F.array("own_note")),
    )
    poor = (
        candidates.join(short_notes, keys, "left")
        .withColumn("text", F.trim(F.array_join(parts, " ")))
        .withColumn("sample", F.when(F.col("n_parts") == 0, F.lit(NO_NOTES)).otherwise(F.col("text")))
        .where((F.col("n_parts") == 0) | (F.length("text") < min_length) | F.lower("text").isin(*GENERIC_NOTES))
    )
    # the finding names every investigation of its case, as its sealed leaf does
    inv_ids = (
        investigations.join(poor.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("o", "event_id"))).alias("inv_ids"))
    )
    poor = poor.join(inv_ids, keys, "left")
    return finding(
        poor, rule, period,
        subject=_event_ref(F.col("case_key")),
        score=rule.severity_base,
        severity="HIGH",
        description=F.format_string("Case %s closed without adequate resolution notes.", "case_key"),
        rationale=F.format_string(
            'Case %s was closed with non-diligent resolution notes ("%s").',
            F.col("case_key"), F.substring("sample", 1, 60),
        ),
        evidence=F.concat(
            F.array(_event_ref(F.col("case_key"))),
            F.coalesce(F.transform("inv_ids", lambda x: x["event_id"]), F.array().cast("array<string>")),
        ),
        evidence_count=1 + F.coalesce("n_investigations", F.lit(0)),
        refs=F.array("case_key"),
        metrics={"notes_length": F.length("sample"), "min_required_length": F.lit(min_length)},
    )


def closure_evidence(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Complete long-form evidence of EG-04 findings: the case and all of its investigations."""
    found = findings.where(F.col("rule_id") == "EG-04").select(
        "finding_id", "entity_id",
        F.col("raw_evidence_refs")[0].alias("case_key"),
        F.col("evidence_record_ids")[0].alias("case_event"),
    )
    related = found.join(
        _case_investigations(events).select("entity_id", "case_key", "event_id"), ["entity_id", "case_key"]
    ).select("finding_id", "entity_id", "event_id")
    return found.select("finding_id", "entity_id", F.col("case_event").alias("event_id")).unionByName(related)


def asset_directory(events: DataFrame) -> DataFrame:
    """(entity, asset key) -> ownership. Assets answer to their id and their host name; last row wins."""
    assets = of_type(events, "asset_inventory").select(
        "entity_id",
        F.explode(key_array(first_of("asset_id", "raw_ref_id"), "hostname")).alias("asset_key"),
        F.struct("owner", "department", "criticality_tier", "hostname", "event_id").alias("info"),
        event_order().alias("o"),
    )
    return assets.groupBy("entity_id", "asset_key").agg(F.max_by("info", "o").alias("info"))


def unowned_assets(events: DataFrame, rule: Rule, period: Period) -> DataFrame:
    """EG-05: alerts on critical assets that lack an owner or a department."""
    alerts = of_type(events, "alert_metadata").select(
        "entity_id", "event_id", "raw_ref_id", "raw_row_index",
        text_of("asset_id", "Unknown").alias("asset_key"),
        F.col("criticality_tier").alias("alert_tier"),
        F.col("owner").alias("alert_owner"),
        F.col("department").alias("alert_department"),
    )
    known = alerts.join(asset_directory(events), ["entity_id", "asset_key"], "left").select(
        "*",
        F.upper(first_of("info.criticality_tier", "alert_tier")).alias("tier"),
        first_of("info.owner", "alert_owner").alias("owner"),
        first_of("info.department", "alert_department").alias("department"),
        first_of("info.hostname", "asset_key").alias("host"),
        text_of("raw_ref_id", "Alert").alias("alert_ref"),
    )
    hits = known.where(
        F.col("tier").isin(*CRITICAL_TIERS) & (F.col("owner").isNull() | F.col("department").isNull())
    )
    return finding(
        hits, rule, period,
        subject=_event_ref(F.col("alert_ref")),
        score=rule.severity_base,
        severity="MEDIUM",
        description=F.format_string("Alert on Crown Jewel asset %s lacking CMDB ownership.", "asset_key"),
        rationale=F.format_string(
            "Crown Jewel asset %s (%s) triggered critical security alerts but lacks an assigned "
            "departmental owner in CMDB.", "host", "asset_key",
        ),
        evidence=F.array_compact(F.array(_event_ref(F.col("alert_ref")), non_blank("info.event_id"))),
        refs=F.array("asset_key", "alert_ref"),
        metrics={
            "criticality_tier": F.col("tier"),
            "owner": F.coalesce("owner", F.lit("UNASSIGNED")),
            "department": F.coalesce("department", F.lit("UNASSIGNED")),
        },
    )


def escalations_without_incident(events: DataFrame, rule: Rule, period: Period, window_seconds: int = 86400) -> DataFrame:
    """EG-06: escalations to senior teams that no incident record follows within a day."""
    target = F.upper(F.coalesce("escalated_to", F.lit("")))
    escalations = (
        of_type(events, "escalation_records")
        .withColumn("esc_to", target)
        .where(reduce(lambda a, b: a | b, [F.contains("esc_to", F.lit(w)) for w in SENIOR_TARGETS]))
        .withColumn("case_key", first_of("case_id", "raw_ref_id"))
        .where(F.col("case_key").isNotNull())
        .withColumn("esc_time", F.coalesce("event_timestamp", "escalated_at"))
    )
    incidents = of_type(events, "incident_reports").withColumn(
        "inc_time", F.coalesce("event_timestamp", "declared_at")
    )
    ids = matched_ids(
        escalations, incidents,
        primary_keys=key_array("case_key"),
        target_keys=key_array(first_of("case_id", "raw_ref_id")),
        primary_time="esc_time", target_time="inc_time",
        before_seconds=0, after_seconds=window_seconds,
    )
    return finding(
        without_match(escalations, ids), rule, period,
        subject=_event_ref(F.col("case_key")),
        score=rule.severity_base,
        severity="HIGH",
        description=F.format_string(
            "Tier-3 IR escalation for Case %s missing incident declaration report.", "case_key"
        ),
        rationale=F.format_string(
            "Tier-3 IR escalation for Case %s was not followed by a formal incident declaration report "
            "within 24 hours.", "case_key",
        ),
        evidence=F.array(_event_ref(F.col("case_key"))),
        refs=F.array(F.col("case_key"), text_of("raw_ref_id", "Escalation")),
        metrics={"escalated_to": F.col("esc_to"), "sla_hours": F.lit(24)},
    )


def rapid_closures(
    events: DataFrame, rule: Rule, period: Period, batch: int = 10, window_seconds: int = 120
) -> DataFrame:
    """EG-07: first run of 10 closures by one analyst within 120 seconds.

    The time line of an analyst is cut into slices as wide as the window, each extended by a copy of
    the next slice, so a busy analyst spreads over many tasks.  Of closures at the same instant only
    the first `batch` can matter: if there are that many, the first of them already starts a hit.
    """
    closed = (
        of_type(events, "case_management")
        .where(F.upper("status").isin(*CLOSED_STATUSES))
        .select(
            "entity_id", "event_id", "raw_ref_id", "raw_row_index",
            first_of("user_id", "assigned_analyst_id", F.lit("Unknown")).alias("analyst"),
            F.coalesce("closed_at", "event_timestamp").alias("closed"),
        )
        .where(F.col("closed").isNotNull())
    )
    tie = W.partitionBy("entity_id", "analyst", "closed").orderBy("raw_row_index", "event_id")
    width = window_seconds * 1_000_000
    rows = (
        closed.withColumn("tie_rank", F.row_number().over(tie))
        .where(F.col("tie_rank") <= batch)
        .withColumn("t", F.unix_micros("closed"))
        .withColumn("own_slice", F.floor(F.col("t") / F.lit(width)).cast("bigint"))
        .withColumn("slice", F.explode(F.array(F.col("own_slice"), F.col("own_slice") - 1)))
    )
    order = W.partitionBy("entity_id", "analyst", "slice").orderBy("t", "raw_row_index", "event_id")
    member = F.struct("event_id", "raw_ref_id", "raw_row_index")
    runs = (
        rows.withColumn("t_last", F.lead("t", batch - 1).over(order))
        .withColumn("run", F.collect_list(member).over(order.rowsBetween(0, batch - 1)))
        .where((F.col("slice") == F.col("own_slice")) & (F.col("t_last") - F.col("t") <= width))
    )
    first = runs.groupBy("entity_id", "analyst").agg(
        F.min_by(F.struct("t", "t_last", "run"), F.struct("t", "raw_row_index", "event_id")).alias("hit")
    ).select(
        "entity_id", "analyst", F.col("hit.run").alias("run"),
        F.floor((F.col("hit.t_last") - F.col("hit.t")) / F.lit(1e6)).cast("bigint").alias("elapsed"),
    )
    return finding(
        first, rule, period,
        subject=F.concat_ws("|", "analyst", F.col("run")[0]["event_id"]),
        score=rule.severity_base,
        severity="CRITICAL",
        description=F.format_string(f"Analyst %s dismissed {batch} cases in %s seconds.", "analyst", "elapsed"),
        rationale=F.format_string(
            f"Analyst %s dismissed {batch} cases in %s seconds, indicating systematic rubber-stamping.",
            "analyst", "elapsed",
        ),
        evidence=F.array_compact(F.transform("run", lambda r: r["event_id"])),
        refs=F.transform("run", lambda r: r["raw_ref_id"]),
        rows=F.array_compact(F.transform("run", lambda r: r["raw_row_index"])),
        metrics={
            "batch_count": F.lit(batch),
            "elapsed_seconds": F.col("elapsed"),
            "threshold_seconds": F.lit(window_seconds),
        },
    )


def off_hours_delays(events: DataFrame, rule: Rule, period: Period, sla_minutes: float = 60.0) -> DataFrame:
    """EG-08: off-hours critical alerts first acted on after more than 60 minutes."""
    _, end = period.columns()
    first_action = (
        of_type(events, "analyst_activity", "investigation_records")
        .withColumn("ref", first_of("alert_id", "raw_ref_id"))
        .where(F.col("ref").isNotNull() & F.col("event_timestamp").isNotNull())
        .groupBy("entity_id", "ref")
        .agg(F.min("event_timestamp").alias("first_action"))
    )
    alerts = (
        of_type(events, "alert_metadata")
        .where(is_high() & F.col("event_timestamp").isNotNull() & is_off_hours("event_timestamp"))
        .withColumn("ref", first_of("raw_ref_id", "alert_id"))
        .select("entity_id", "event_id", "ref", "raw_row_index", "event_timestamp")
    )
    delays = alerts.join(first_action, ["entity_id", "ref"], "left").withColumn(
        "minutes",
        F.when(
            F.col("first_action").isNotNull(),
            F.greatest(F.lit(0.0), seconds_between("first_action", "event_timestamp") / 60.0),
        ).otherwise(F.greatest(F.lit(60.0), seconds_between(end, "event_timestamp") / 60.0)),
    ).where(F.col("minutes") > sla_minutes)
    minutes = F.floor("minutes").cast("bigint")
    return finding(
        delays, rule, period,
        subject=_event_ref(F.col("ref")),
        score=rule.severity_base,
        severity="HIGH",
        description=F.format_string(
            "Off-hours critical alert %s triage delay breached 60-minute SLA.", "ref"
        ),
        rationale=F.format_string(
            "Off-hours critical alert %s experienced triage delay of %s minutes, breaching the 60-minute "
            "off-hours SLA.", F.col("ref"), minutes,
        ),
        evidence=F.array(_event_ref(F.col("ref"))),
        refs=F.array("ref"),
        metrics={
            "delay_minutes": minutes,
            "sla_threshold_minutes": F.lit(60),
            "is_weekend": is_weekend("event_timestamp"),
            "is_night": is_night("event_timestamp"),
        },
    )


def declarative_rule(events: DataFrame, rule: Rule, period: Period) -> DataFrame:
    """Custom rule: filter, optional temporal join, text templates with {rule_code}, {name},
    {entity_id} and {ref_id}."""
    wanted = rule.target_dataset
    target = events.where((F.col("dataset_type") == wanted) | (F.col("standard_event_type") == wanted.upper()))
    target = target.where(compile_condition(rule.condition, target))
    target = temporal_join(target, rule.join, events)

    def render(template: str) -> Column:
        text = F.lit(template)
        values = {
            "rule_code": F.lit(rule.code),
            "name": F.lit(rule.name),
            "entity_id": F.col("entity_id"),
            "ref_id": F.coalesce("raw_ref_id", F.lit("None")),
        }
        for key, value in values.items():
            text = F.replace(text, F.lit("{" + key + "}"), value)
        return text

    return finding(
        target, rule, period,
        subject=F.col("event_id"),
        score=rule.severity_base,
        description=render(rule.description),
        rationale=render(rule.rationale),
        evidence=F.array("event_id"),
        refs=F.array_compact(F.array(non_blank("raw_ref_id"))),
    )


BUILTIN = {
    "EG-01": uninvestigated_alerts,
    "EG-02": escalation_breaches,
    "EG-03": stale_cases,
    "EG-04": closed_without_notes,
    "EG-05": unowned_assets,
    "EG-06": escalations_without_incident,
    "EG-07": rapid_closures,
    "EG-08": off_hours_delays,
}


def evaluate_rules(events: DataFrame, period: Period, registry: Registry | None = None) -> DataFrame:
    """Findings of all active rules, built-in and custom."""
    rules = (registry or rule_registry()).list()
    if not rules:
        raise ValueError("no active rules")
    parts = [BUILTIN.get(rule.code, declarative_rule)(events, rule, period) for rule in rules]
    return reduce(DataFrame.unionByName, parts)
