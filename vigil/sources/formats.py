"""File-level detection: delimiter, container format, header tokens and dataset type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scalars import c
from vigil.schema import DATASETS

DELIMITERS = (",", "\t", ";", "|")  # fixed values, in order of preference

# Fixed values per dataset type, in canonical order: primary key, its aliases, discriminating headers,
# common headers, file name words, number prefix.
DATASET_SIGNS = {
    "alert_metadata": (
        "alert_id", ("alert_id", "alertid", "alert_uid", "incident_id", "id"),
        ("rule_name", "source_ip", "destination_ip", "signature_name", "eventtime_utc", "srcaddr", "dstaddr"),
        ("severity", "status", "description", "criticality_tier", "asset_id", "owner", "department", "timestamp"),
        ("alert", "alerts", "siem", "edr", "sensor_alerts"), "01"),
    "case_management": (
        "case_id", ("case_id", "caseid", "ticket_id", "case_number", "id"),
        ("assigned_analyst", "priority", "closed_at", "opened_at", "ticket_id"),
        ("created_at", "updated_at", "status", "severity", "title", "description", "notes"),
        ("case", "cases", "ticket", "tickets", "case_management", "triage_cases"), "02"),
    "investigation_records": (
        "investigation_id", ("investigation_id", "inv_id", "investigationid", "id"),
        ("investigation_action", "findings_summary", "time_spent_minutes", "analyst_id", "inv_id"),
        ("case_id", "alert_id", "timestamp", "notes"),
        ("investigation", "investigations", "inv", "forensic", "investigation_records"), "03"),
    "escalation_records": (
        "escalation_id", ("escalation_id", "esc_id", "escalationid", "id"),
        ("escalated_from", "escalated_to", "escalation_reason", "approval_status", "esc_id"),
        ("case_id", "alert_id", "timestamp", "notes"),
        ("escalation", "escalations", "esc", "tier_escalation", "escalation_records"), "04"),
    "asset_inventory": (
        "asset_id", ("asset_id", "assetid", "device_id", "id"),
        ("hostname", "ip_address", "asset_type", "os", "is_monitored", "targethost", "device_id"),
        ("criticality_tier", "department", "owner"),
        ("asset", "assets", "inventory", "cmdb", "hosts", "asset_inventory"), "05"),
    "incident_reports": (
        "incident_id", ("incident_id", "incidentid", "report_id", "id"),
        ("root_cause", "attack_vector", "financial_impact", "declared_at", "contained_at"),
        ("case_id", "title", "severity", "closed_at"),
        ("incident", "incidents", "major_incident", "incident_reports", "breach"), "06"),
    "coverage_reports": (
        "coverage_id", ("coverage_id", "coverageid", "report_id", "id"),
        ("tool_name", "source_type", "total_assets_monitored", "active_sensors", "coverage_percentage",
         "uptime_pct", "event_count"),
        ("asset_id", "reported_at"),
        ("coverage", "coverage_reports", "sensor", "sensor_health", "detection_coverage"), "07"),
    "analyst_activity": (
        "activity_id", ("activity_id", "activityid", "log_id", "id"),
        ("activity_type", "duration_seconds", "session_id", "entity_ref_id", "action_taken", "shift_start", "shift_end"),
        ("analyst_id", "timestamp", "alert_id", "case_id"),
        ("activity", "analyst", "analyst_activity", "shifts", "console_activity", "analyst_logs"), "08"),
}


def detect_delimiter(head_lines: Column) -> Column:
    """Delimiter of an array of head lines: the most frequent one with the same non-zero count outside
    quotes on every line, else the first one present in the first line, else a comma."""
    bare = F.transform(head_lines, lambda line: F.regexp_replace(line, r'"[^"]*"', ""))

    def counts_of(d: str) -> Column:
        return F.transform(bare, lambda line: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))))

    options = []
    for rank, d in enumerate(DELIMITERS):
        counts = counts_of(d)
        steady = (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 0)
        options.append(
            F.when(steady, F.struct(F.array_min(counts).alias("n"), F.lit(-rank).alias("r"), F.lit(d).alias("d")))
        )
    best = F.array_max(F.array_compact(F.array(*options)))["d"]
    first = F.get(head_lines, F.lit(0))
    present = [F.when(F.contains(first, F.lit(d)), F.lit(d)) for d in DELIMITERS]
    return F.coalesce(best, *present, F.lit(","))


def detect_format(first_line: Column | str) -> Column:
    """json when the content starts with a brace or bracket, else csv."""
    return F.when(F.ltrim(c(first_line)).rlike(r"^[\{\[]"), "json").otherwise("csv")


def header_tokens(snippet: Column | str) -> Column:
    """Lower-cased field names of the first JSON record or of the first delimited line."""
    text = F.trim(F.regexp_replace(c(snippet), "^﻿", ""))
    is_json = text.rlike(r"^[\{\[]")
    record = F.when(F.startswith(text, F.lit("[")), F.get_json_object(text, "$[0]")).otherwise(text)
    keys = F.transform(F.json_object_keys(record), lambda k: F.lower(F.trim(k)))
    loose = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(r'"([a-zA-Z0-9_]+)"\s*:'), 1), F.lower)
    )
    line = F.regexp_extract(text, r"^([^\r\n]*)", 1)
    delimiter = (
        F.when(F.contains(line, F.lit("\t")), "\t")
        .when(F.contains(line, F.lit(",")), ",")
        .when(F.contains(line, F.lit(";")), ";")
        .when(F.contains(line, F.lit("|")), "|")
        .otherwise(",")
    )
    cells = F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))
    cleaned = F.transform(
        cells,
        lambda h: F.regexp_replace(
            F.lower(F.trim(F.regexp_replace(F.trim(h), r"""^["']|["']$""", ""))), r"[\s-]+", "_"
        ),
    )
    named = F.filter(cleaned, lambda h: h != "")
    return F.when(is_json, F.coalesce(keys, loose)).otherwise(named)


def classify_dataset(file_name: Column | str, tokens: Column | str) -> Column:
    """struct(dataset_type, score, confidence, matched_headers): best of eight scored signatures.

    `tokens` is read by every signature and should be a column, not an expression.
    """
    name = F.lower(c(file_name))
    headers = c(tokens)
    scored = []
    for rank, dataset in enumerate(DATASETS):
        key, aliases, discriminators, common, words, prefix = DATASET_SIGNS[dataset]
        hit = F.get(F.filter(F.array(*[F.lit(a) for a in aliases]), lambda a: F.array_contains(headers, a)), F.lit(0))
        key_points = F.when(hit == key, 50).when(hit.isNotNull(), 35).otherwise(0)
        found = F.array_intersect(F.array(*[F.lit(d) for d in discriminators]), headers)
        shared = F.array_intersect(F.array(*[F.lit(h) for h in common]), headers)
        numbered = name.rlike(rf"^{prefix}[_.\-]") | name.rlike(rf"[/\\]{prefix}_")
        word_points = F.greatest(
            *[F.when(F.contains(name, F.lit(w)), 20 + min(len(w), 15)).otherwise(0) for w in words], F.lit(0)
        )
        name_points = F.when(F.contains(name, F.lit(dataset)), 35).otherwise(word_points)
        score = (
            key_points + 20 * F.size(found) + 5 * F.size(shared) + F.when(numbered, 40).otherwise(0) + name_points
        )
        scored.append(
            F.struct(
                score.cast("bigint").alias("score"),
                F.lit(-rank).alias("order"),
                F.lit(dataset).alias("dataset_type"),
                F.array_distinct(F.concat(F.array_compact(F.array(hit)), found, shared)).alias("matched"),
            )
        )

    def result(best: Column) -> Column:
        score = best["score"]
        confidence = (
            F.when(score >= 70, 100).when(score >= 45, 90).when(score >= 25, 75).when(score > 0, 60).otherwise(50)
        )
        return F.struct(
            best["dataset_type"].alias("dataset_type"), score.alias("score"),
            confidence.cast("bigint").alias("confidence"), best["matched"].alias("matched_headers"),
        )

    # the lambda binds the winner once for all its fields
    return F.transform(F.array(F.array_max(F.array(*scored))), result)[0]
