"""Normalisation of raw rows to canonical events, driven by field aliases and mapping profiles."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import clean_key, clean_name, normalize_severity, normalize_status, stable_id, to_float
from vigil.functions.timestamps import parse_iso, parse_timestamp
from vigil.schema import DATASET_EVENT_TYPE, PROMOTED, SEVERITIES

# Primary key names per dataset type.
PRIMARY_KEYS = {
    "alert_metadata": ("alert_id", "Incident_ID", "alertId", "alert_uid", "id"),
    "case_management": ("case_id", "ticket_id", "caseId", "case_number", "id"),
    "investigation_records": ("investigation_id", "inv_id", "investigationId", "id"),
    "escalation_records": ("escalation_id", "esc_id", "escalationId", "id"),
    "asset_inventory": ("asset_id", "assetId", "device_id", "id"),
    "incident_reports": ("incident_id", "incidentId", "report_id", "id"),
    "coverage_reports": ("coverage_id", "coverageId", "report_id", "id"),
    "analyst_activity": ("activity_id", "activityId", "log_id", "id"),
}
# Names a canonical field is read from, in order.
ALIASES = {
    "raw_ref_id": (
        "alert_id", "case_id", "investigation_id", "escalation_id", "asset_id", "incident_id",
        "coverage_id", "activity_id", "id", "Incident_ID", "ticket_id", "alertId", "caseId", "inv_id",
        "esc_id", "report_id",
    ),
    "event_timestamp": (
        "timestamp", "event_timestamp", "event_time", "EventTime_UTC", "created_at", "declared_at",
        "reported_at", "escalated_at", "opened_at", "time", "@timestamp", "activity_time",
    ),
    "asset_id": (
        "asset_id", "hostname", "TargetHost", "device_id", "target_asset", "affected_asset",
        "affected_assets", "host", "server_name",
    ),
    "user_id": (
        "analyst_id", "user_id", "assigned_analyst", "assigned_analyst_id", "escalated_by",
        "escalated_from", "operator_id", "owner", "owner_email",
    ),
    "action": (
        "action", "rule_name", "Signature_Name", "alert_name", "investigation_action", "activity_type",
        "title", "tool_name", "action_taken",
    ),
    "status": ("status", "State", "approval_status", "resolution", "resolution_code", "state"),
    "severity": ("severity", "RiskLevel", "priority", "criticality", "criticality_tier", "level"),
    "source_ip": ("source_ip", "src_ip", "SrcAddr", "src_addr", "sourceIp", "client_ip"),
    "destination_ip": (
        "destination_ip", "dest_ip", "dst_ip", "DstAddr", "dst_addr", "destinationIp", "target_ip",
    ),
}
MAP = "map<string,string>"


@dataclass(frozen=True)
class Profile:
    """Mapping profile of one entity and dataset type."""

    entity_id: str
    dataset_type: str
    rules: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    severity_map: dict[str, str] = field(default_factory=dict)
    severity_default: str | None = None
    date_format: str | None = None
    version: int = 1
    is_active: bool = True


PROFILE_SCHEMA = (
    f"entity_id string, dataset_type string, rules {MAP}, defaults {MAP}, severity_map {MAP}, "
    "severity_default string, date_format string, version int, is_active boolean"
)


def profile_table(spark, profiles: list[Profile]) -> DataFrame:
    rows = [
        (p.entity_id, p.dataset_type, p.rules, p.defaults, {k.lower(): v for k, v in p.severity_map.items()},
         p.severity_default, p.date_format, p.version, p.is_active)
        for p in profiles
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def active_profiles(profiles: DataFrame) -> DataFrame:
    """Highest active version per entity and dataset type."""
    rest = [c for c in profiles.columns if c not in ("entity_id", "dataset_type")]
    return (
        profiles.where("is_active")
        .groupBy("entity_id", "dataset_type")
        .agg(F.max_by(F.struct(*rest), "version").alias("p"))
        .select("entity_id", "dataset_type", "p.*")
    )


def with_profiles(rows: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Attach each row's active profile; without profiles the columns are NULL."""
    names = ("rules", "defaults", "severity_map")
    if profiles is None:
        for n in names:
            rows = rows.withColumn(n, F.lit(None).cast(MAP))
        return rows.withColumn("severity_default", F.lit(None).cast("string")).withColumn(
            "date_format", F.lit(None).cast("string")
        )
    chosen = active_profiles(profiles).select(
        "entity_id", "dataset_type", *names, "severity_default", "date_format"
    )
    return rows.join(chosen, ["entity_id", "dataset_type"], "left")


def _empty() -> Column:
    return F.create_map().cast(MAP)


def with_defaults(data: Column, defaults: Column) -> Column:
    """Profile defaults fill missing and NULL fields."""
    return F.map_concat(
        F.map_filter(data, lambda _, v: v.isNull()),
        F.coalesce(defaults, _empty()),
        F.map_filter(data, lambda _, v: v.isNotNull()),
    )


def renamed(data: Column, rules: Column) -> Column:
    """Fields renamed by a profile, whichever of a rule's two names is the source."""
    entries = F.transform(
        F.map_entries(F.coalesce(rules, _empty())),
        lambda r: F.when(data[r["key"]].isNotNull(), F.struct(r["value"].alias("key"), data[r["key"]].alias("value")))
        .when(data[r["value"]].isNotNull(), F.struct(r["key"].alias("key"), data[r["value"]].alias("value"))),
    )
    return F.map_from_entries(F.array_compact(entries))


def cleaned_lookup(data: Column) -> Column:
    """Cleaned name -> value; of names equal after cleaning the first one with a value counts."""
    entries = F.map_entries(F.map_filter(data, lambda _, v: v.isNotNull()))
    # later entries win in a map, so the order is reversed
    return F.map_from_entries(
        F.transform(F.reverse(entries), lambda e: F.struct(clean_key(e["key"]).alias("key"), e["value"].alias("value")))
    )


def _by_names(data: Column, lookup: Column, names: tuple[str, ...]) -> list[Column]:
    out = []
    for n in names:
        out += [data[n], lookup[clean_name(n)]]
    return out


def extract_field(name: str) -> Column:
    """Canonical field of a row: renamed value, dataset primary key (for raw_ref_id), then aliases."""
    mapped, data, lookup = F.col("mapped"), F.col("full"), F.col("lookup")
    parts = [mapped[name]]
    if name == "raw_ref_id":
        own = reduce(
            lambda acc, item: acc.when(
                F.col("dataset_type") == item[0], F.coalesce(*_by_names(data, lookup, item[1]))
            ),
            PRIMARY_KEYS.items(),
            F.when(F.lit(False), F.lit(None).cast("string")),
        )
        parts.append(own)
    return F.coalesce(*parts, *_by_names(data, lookup, ALIASES.get(name, (name,))))


def standard_event_type(dataset: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in DATASET_EVENT_TYPE.items() for x in item])
    return F.coalesce(table[dataset], F.lit("ALERT"))


def _promoted_raw(name: str) -> Column:
    return F.coalesce(F.col("payload")[name], F.col("payload_lookup")[clean_name(name)])


def _typed(value: Column, dtype: str) -> Column:
    if dtype == "timestamp":
        return parse_iso(value)
    return to_float(value) if dtype == "double" else value


def _list_text(value: Column) -> Column:
    """A JSON list of ids reads as its items joined by commas."""
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
    return F.coalesce(F.array_join(items, ","), value)


def normalize(
    rows: DataFrame,
    ingested_at: datetime,
    profiles: DataFrame | None = None,
    date_formats: tuple[str, ...] = (),
) -> DataFrame:
    """Canonical events of parsed rows (submission_id, entity_id, dataset_type, row_index, data).

    `date_formats` lists the custom strptime layouts in use by profiles: a layout must be a constant
    of the plan.  Rows without a usable time get `ingested_at`.
    """
    known = F.col("dataset_type").isin(*DATASET_EVENT_TYPE)
    df = with_profiles(
        rows.withColumn("dataset_type", F.when(known, F.col("dataset_type")).otherwise("alert_metadata")), profiles
    )
    df = (
        df.withColumn("full", with_defaults(F.col("data"), F.col("defaults")))
        .withColumn("mapped", renamed(F.col("full"), F.col("rules")))
        .withColumn("lookup", cleaned_lookup(F.col("full")))
    )
    layouts = {f: F.col("date_format") == f for f in date_formats}
    severity_default = F.coalesce(
        F.when(F.upper("severity_default").isin(*SEVERITIES), F.upper("severity_default")), F.lit("MEDIUM")
    )
    payload = F.map_concat(
        F.col("full"), F.col("mapped"),
        F.create_map(
            F.lit("_row_index"), F.col("row_index").cast("string"),
            F.lit("_standard_event_type"), standard_event_type(F.col("dataset_type")),
        ),
    )
    # each field is looked up once, in a projection of its own, and then interpreted
    df = df.select(
        "*", *[extract_field(n).alias(f"raw_{n}" if n != "raw_ref_id" else n) for n in ALIASES], payload.alias("payload")
    ).withColumn("payload_lookup", cleaned_lookup(F.col("payload")))
    df = df.select("*", *[_promoted_raw(n).alias(f"p_{n}") for n in PROMOTED])
    ingested = F.lit(ingested_at).cast("timestamp")
    return df.select(
        stable_id(F.lit("event"), "submission_id", "row_index").alias("event_id"),
        "submission_id", "entity_id", "dataset_type",
        standard_event_type(F.col("dataset_type")).alias("standard_event_type"),
        F.coalesce(parse_timestamp("raw_event_timestamp", layouts), ingested).alias("event_timestamp"),
        _list_text(F.col("raw_asset_id")).alias("asset_id"),
        F.col("raw_user_id").alias("user_id"),
        F.col("raw_action").alias("action"),
        F.when(F.col("raw_status").isNotNull(), normalize_status("raw_status")).alias("status"),
        normalize_severity("raw_severity", F.col("severity_map"), severity_default).alias("severity"),
        F.col("raw_source_ip").alias("source_ip"),
        F.col("raw_destination_ip").alias("destination_ip"),
        F.col("row_index").cast("bigint").alias("raw_row_index"),
        "raw_ref_id",
        *[_typed(F.col(f"p_{n}"), t).alias(n) for n, t in PROMOTED.items()],
        F.col("payload").alias("normalized_payload"),
        ingested.alias("created_at"),
    )
