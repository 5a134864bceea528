"""Data model: the canonical event table, its enumerations and the columns promoted from the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The eight dataset types and the event type each one becomes.
DATASET_EVENT_TYPE = {
    "alert_metadata": "ALERT",
    "case_management": "CASE",
    "investigation_records": "INVESTIGATION",
    "escalation_records": "ESCALATION",
    "asset_inventory": "ASSET",
    "incident_reports": "INCIDENT",
    "coverage_reports": "COVERAGE",
    "analyst_activity": "ACTIVITY",
}
DATASETS = tuple(DATASET_EVENT_TYPE)

# Enumerations.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL")
RISK_TIERS = ("LOW", "GUARDED", "ELEVATED", "CRITICAL")
HIGH_SEVERITIES = ("CRITICAL", "HIGH")
CLOSED_STATUSES = ("CLOSED", "RESOLVED")

CANONICAL = {
    "event_id": "string",
    "submission_id": "string",
    "entity_id": "string",
    "dataset_type": "string",
    "standard_event_type": "string",
    "event_timestamp": "timestamp",
    "asset_id": "string",
    "user_id": "string",
    "action": "string",
    "status": "string",
    "severity": "string",
    "source_ip": "string",
    "destination_ip": "string",
    "raw_row_index": "bigint",
    "raw_ref_id": "string",
}

# Payload keys the rules read, as typed nullable columns: Catalyst can prune and push these down,
# which it cannot do for entries of the payload map.
PROMOTED = {
    "case_id": "string",
    "alert_id": "string",
    "incident_id": "string",
    "priority": "string",
    "closed_at": "timestamp",
    "escalation_delay_minutes": "double",
    "escalation_status": "string",
    "escalated_at": "timestamp",
    "escalated_to": "string",
    "resolution_time_hours": "double",
    "investigation_notes": "string",
    "conclusion": "string",
    "notes": "string",
    "resolution_notes": "string",
    "owner": "string",
    "department": "string",
    "criticality_tier": "string",
    "hostname": "string",
    "declared_at": "timestamp",
    "resolved_at": "timestamp",
    "rule_id": "string",
    "alert_name": "string",
    "uptime_pct": "double",
    "time_spent_minutes": "double",
    "action_taken": "string",
    "analyst_id": "string",
    "assigned_analyst_id": "string",
}

PAYLOAD = "normalized_payload"
EVENT_COLUMNS = {**CANONICAL, **PROMOTED, PAYLOAD: "map<string,string>"}

ENTITY_COLUMNS = {
    "entity_id": "string",
    "entity_code": "string",
    "name": "string",
    "sector": "string",
    "size_tier": "string",
    "is_active": "boolean",
}


def conform(df: DataFrame, columns: dict[str, str] = EVENT_COLUMNS) -> DataFrame:
    """Give `df` exactly the given columns: missing ones become typed NULLs, others are cast."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name).cast(dtype) if name in present else F.lit(None).cast(dtype)).alias(name)
            for name, dtype in columns.items()
        ]
    )


def event_family(df: DataFrame, dataset_type: str) -> DataFrame:
    """Conform rows to the canonical event table as one dataset type."""
    return conform(
        df.withColumn("dataset_type", F.lit(dataset_type)).withColumn(
            "standard_event_type", F.lit(DATASET_EVENT_TYPE[dataset_type])
        )
    )


def of_type(events: DataFrame, *dataset_types: str) -> DataFrame:
    """Rows of the given dataset types. The plain predicate prunes partitions and union branches."""
    return events.where(F.col("dataset_type").isin(*dataset_types))


def is_high(severity: Column | str = "severity") -> Column:
    column = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(F.upper(column).isin(*HIGH_SEVERITIES), F.lit(False))


def event_order() -> Column:
    """Total order of rows inside a submission's time line: time, then row index, then id."""
    return F.struct("event_timestamp", "raw_row_index", "event_id")
