"""Row validation and quarantine: the first failing check of each row, duplicates, batch status."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import clean_key, clean_name, is_float_text, stable_id
from vigil.functions.timestamps import parse_timestamp
from vigil.session import cut_lineage

# Per dataset type, groups of names of which one must hold a value; the first group is
# the primary key.
REQUIRED_GROUPS = {
    "alert_metadata": (
        ("alert_id", "id", "Incident_ID", "alertId", "event_id", "alert_uid"),
        ("timestamp", "event_time", "EventTime_UTC", "time", "created_at", "@timestamp"),
    ),
    "case_management": (
        ("case_id", "id", "ticket_id", "caseId", "case_number"),
        ("created_at", "timestamp", "opened_at", "creation_time"),
    ),
    "investigation_records": (
        ("investigation_id", "id", "inv_id", "investigationId"),
        ("case_id", "alert_id", "ticket_id", "caseId"),
        ("timestamp", "investigated_at", "action_time", "created_at"),
    ),
    "escalation_records": (
        ("escalation_id", "id", "esc_id", "escalationId"),
        ("escalated_at", "timestamp", "created_at"),
    ),
    "asset_inventory": (("asset_id", "id", "hostname", "assetId", "device_id"),),
    "incident_reports": (
        ("incident_id", "id", "incidentId", "report_id"),
        ("declared_at", "timestamp", "report_timestamp", "incident_date", "created_at", "report_date"),
    ),
    "coverage_reports": (
        ("coverage_id", "id", "report_id", "coverageId", "tool_name"),
        ("reported_at", "timestamp", "reporting_period_start", "created_at"),
    ),
    "analyst_activity": (
        ("activity_id", "id", "log_id", "activityId"),
        ("analyst_id", "user_id", "analyst", "operator_id"),
        ("timestamp", "activity_time", "created_at", "event_time"),
    ),
}
# Fixed values.
NUMERIC_FIELDS = (
    "uptime_pct", "coverage_percentage", "time_spent_minutes", "financial_impact",
    "financial_impact_estimate", "event_count", "total_assets_monitored", "active_sensors", "duration_seconds",
)
TIME_FIELDS = (
    "timestamp", "event_timestamp", "event_time", "EventTime_UTC", "created_at", "declared_at",
    "reported_at", "escalated_at", "time", "@timestamp",
)
GENERIC_KEYS = (
    "alert_id", "case_id", "investigation_id", "escalation_id", "coverage_id", "incident_id",
    "activity_id", "asset_id", "id", "Incident_ID", "ticket_id",
)

DATA = "data"
ERROR = "struct<code:string,message:string,fields:array<string>>"


def _error(code: str, message: Column | str, fields: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), text.alias("message"), fields.alias("fields")).cast(ERROR)


def _has_text(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def present_names(data: Column, mapping: Column | None = None) -> Column:
    """Cleaned names under which the row holds a value, including names reached by a mapping profile."""
    own = F.transform(F.map_keys(F.map_filter(data, lambda _, v: _has_text(v))), clean_key)
    if mapping is None:
        return own
    via = F.transform(
        F.map_values(F.map_filter(mapping, lambda source, _: _has_text(data[source]))), clean_key
    )
    return F.concat(own, F.coalesce(via, F.array().cast("array<string>")))


def _missing_group(names: Column, dataset: Column) -> Column:
    parts = []
    for dataset_type, groups in REQUIRED_GROUPS.items():
        for group in groups:
            wanted = F.array(*[F.lit(n) for n in dict.fromkeys(clean_name(g) for g in group)])
            parts.append(
                F.when(
                    (dataset == dataset_type) & ~F.arrays_overlap(names, wanted),
                    _error(
                        "MISSING_REQUIRED_FIELD",
                        f"Missing mandatory field from candidate group: {list(group)}",
                        F.array(F.lit(group[0])),
                    ),
                )
            )
    return F.coalesce(*parts)


def _first_named(data: Column, names: tuple[str, ...], usable) -> tuple[Column, Column]:
    """(name, value) of the first of `names` whose value is usable."""
    name = F.coalesce(*[F.when(usable(data[n]), F.lit(n)) for n in names])
    value = F.coalesce(*[F.when(usable(data[n]), data[n]) for n in names])
    return name, value


def primary_key(data: Column, dataset: Column) -> Column:
    """Value under the first name of the id group, else under the generic id names."""
    own = reduce(
        lambda acc, item: acc.when(
            dataset == item[0], _first_named(data, item[1][0], _has_text)[1]
        ),
        REQUIRED_GROUPS.items(),
        F.when(F.lit(False), F.lit(None).cast("string")),
    )
    return F.coalesce(own, *[data[n] for n in GENERIC_KEYS])


def repeated_key(key: Column) -> Column:
    """The error of a row whose key another row has claimed."""
    text = F.concat(F.lit("Duplicate primary key '"), key, F.lit("' encountered in batch"))
    return _error("DUPLICATE_PRIMARY_KEY", text, F.array(F.lit("primary_key")))


def with_row_error(rows: DataFrame, mapping: str | None = None) -> DataFrame:
    """Add `error`, the first failing row check, or NULL. Duplicates are judged afterwards, among
    clean rows.

    Names, time and first bad number become columns of their own first: every later use would
    otherwise evaluate the lookups in the row's map again.
    """
    data = F.col(DATA)
    time_name, time_value = _first_named(data, TIME_FIELDS, lambda v: v.isNotNull())
    bad_numbers = F.filter(
        F.map_entries(data),
        lambda e: e["key"].isin(*NUMERIC_FIELDS) & e["value"].isNotNull() & ~is_float_text(e["value"]),
    )
    staged = rows.select(
        "*",
        present_names(data, F.col(mapping) if mapping else None).alias("_names"),
        time_name.alias("_time_name"),
        time_value.alias("_time_value"),
        F.get(bad_numbers, F.lit(0)).alias("_bad"),
    ).withColumn("_time", parse_timestamp("_time_value"))
    raw = F.array(F.lit("__raw__"))
    corrupted = F.when(
        F.col("is_corrupted"),
        _error("CORRUPTED_ROW", F.coalesce("corruption_reason", F.lit("Corrupted raw record")), raw),
    )
    empty = F.when(
        data.isNull() | (F.size(data) == 0),
        _error("CORRUPTED_ROW", "Row data is empty or not a valid dictionary", raw),
    )
    missing = _missing_group(F.col("_names"), F.col("dataset_type"))
    bad_time = F.when(
        F.col("_time_value").isNotNull() & F.col("_time").isNull(),
        _error(
            "DATETIME_PARSE_ERROR",
            F.concat(F.lit("Unable to parse timestamp '"), "_time_value", F.lit("' in field '"), "_time_name", F.lit("'")),
            F.array("_time_name"),
        ),
    )
    bad = F.col("_bad")
    mismatch = F.when(
        bad.isNotNull(),
        _error(
            "TYPE_MISMATCH",
            F.concat(F.lit("Field '"), bad["key"], F.lit("' with value '"), bad["value"], F.lit("' cannot be converted to number")),
            F.array(bad["key"]),
        ),
    )
    first_error = F.coalesce(corrupted, empty, missing, bad_time, mismatch)
    # reading the partition id keeps later predicates on `error` from being pushed below this
    # projection, which would evaluate all checks again inside every such predicate
    return staged.withColumn("error", F.when(F.spark_partition_id() >= 0, first_error)).drop(
        "_names", "_time_name", "_time_value", "_time", "_bad"
    )


def validate(rows: DataFrame, mapping: str | None = None) -> DataFrame:
    """Add `error` (NULL for valid rows). `rows` are parsed rows with submission_id, entity_id and
    dataset_type; `mapping` names an optional map<string,string> column of a mapping profile.

    Of valid rows sharing a primary key in a submission, the one with the lowest row index stays.
    The checked rows are stored, so that each text is parsed once.  Only sound rows with a key are joined,
    with the keys that repeat; all others go past the join.
    """
    checked = cut_lineage(with_row_error(rows, mapping).withColumn(
        "pk", F.when(F.col("error").isNull(), primary_key(F.col(DATA), F.col("dataset_type")))
    ))
    keyed = F.coalesce(F.col("pk") != "", F.lit(False))
    repeated = (
        checked.where(keyed)
        .groupBy("submission_id", "pk")
        .agg(F.min("row_index").alias("first_row"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .drop("copies")
    )
    duplicate = F.when(F.col("error").isNull() & (F.col("row_index") > F.col("first_row")), repeated_key(F.col("pk")))
    joined = checked.where(keyed).join(repeated, ["submission_id", "pk"], "left").withColumn(
        "error", F.coalesce("error", duplicate))
    return joined.select(*rows.columns, "error").unionByName(checked.where(~keyed).select(*rows.columns, "error"))


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("error").isNull()).drop("error")


def quarantined_rows(validated: DataFrame, quarantined_at: datetime) -> DataFrame:
    """Quarantine table: `[CODE] message`, failed fields, the raw content."""
    return validated.where(F.col("error").isNotNull()).select(
        stable_id(F.lit("quarantine"), "submission_id", "row_index").alias("quarantine_id"),
        "submission_id", "entity_id", "dataset_type", "row_index",
        F.coalesce(F.col(DATA), F.create_map().cast("map<string,string>")).alias("raw_content"),
        F.concat(F.lit("["), F.col("error.code"), F.lit("] "), F.col("error.message")).alias("failure_reason"),
        F.when(F.size("error.fields") > 0, F.col("error.fields")).otherwise(F.array(F.lit("__unknown__"))).alias("failed_fields"),
        F.lit(quarantined_at).cast("timestamp").alias("quarantined_at"),
    )


def submission_status(validated: DataFrame, submissions: DataFrame) -> DataFrame:
    """Counts, status and error text per submission; submissions without rows have failed."""
    counts = validated.groupBy("submission_id").agg(
        F.count("*").alias("row_count"), F.count_if(F.col("error").isNull()).alias("valid_row_count")
    )
    df = submissions.join(counts, "submission_id", "left").na.fill(0, ["row_count", "valid_row_count"])
    bad = F.col("row_count") - F.col("valid_row_count")
    return df.select(
        *submissions.columns, "row_count", "valid_row_count",
        bad.alias("quarantined_row_count"),
        F.when(F.col("row_count") == 0, "FAILED")
        .when(bad == 0, "NORMALIZED")
        .when(F.col("valid_row_count") > 0, "PARTIAL_SUCCESS")
        .otherwise("FAILED").alias("ingestion_status"),
        F.when(F.col("row_count") == 0, "No rows found in input data")
        .when(bad == 0, F.lit(None).cast("string"))
        .when(F.col("valid_row_count") > 0, F.format_string("%s rows quarantined due to validation errors", bad))
        .otherwise("All rows failed schema validation and were quarantined").alias("error_summary"),
    )


def quarantine_summary(quarantined: DataFrame) -> DataFrame:
    """Counts per reason code and per failed field in long form: kind, label, rows."""
    keys = ["submission_id", "entity_id"]
    code = F.regexp_extract("failure_reason", r"^\[([A-Z_]+)\]", 1)
    by_reason = quarantined.groupBy(*keys, code.alias("label")).agg(F.count("*").alias("rows"))
    by_field = (
        quarantined.select(*keys, F.explode("failed_fields").alias("label"))
        .groupBy(*keys, "label")
        .agg(F.count("*").alias("rows"))
    )
    return by_reason.withColumn("kind", F.lit("reason")).unionByName(by_field.withColumn("kind", F.lit("field")))


def evaluation_skips(rows: DataFrame) -> DataFrame:
    """Rows an evaluation run leaves out: alerts without id, invalid dates, a sentinel uptime."""
    data, kind = F.col(DATA), F.col("dataset_type")
    skip = (
        ((kind == "alert_metadata") & data["alert_id"].isNull())
        | ((kind == "case_management") & F.contains(F.coalesce(data["created_at"], F.lit("")), F.lit("INVALID_DATE")))
        | ((kind == "coverage_reports") & (data["uptime_pct"] == "CORRUPTED_NOT_A_FLOAT"))
    )
    return rows.where(~F.coalesce(skip, F.lit(False)))
