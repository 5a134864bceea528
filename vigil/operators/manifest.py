"""Audit manifests: leaf digests of every stored table, subtree and composite roots, verification."""

from __future__ import annotations

from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.canonical import EMPTY_DIGEST, json_array, json_map, json_number, json_object, json_text, sha256
from vigil.functions.scalars import stable_id
from vigil.operators.execution_gaps import Period
from vigil.operators.merkle import composite_root, merkle_roots

COMPONENTS = (
    "raw_submissions_sha256",
    "quarantined_records_sha256",
    "normalized_events_sha256",
    "findings_and_scores_sha256",
)


def _iso(name: str, timespec: str = "auto") -> Column:
    """ISO-8601 text in UTC; microseconds only when present (`auto`), or always (`microseconds`)."""
    if timespec not in ("auto", "microseconds"):
        raise ValueError(f"unknown timespec {timespec!r}")
    ts = F.col(name)
    if timespec == "microseconds":
        return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit("")), F.lit("+00:00"))


def _r4(name: str) -> Column:
    return json_number(F.round(name, 4))


def _leaves(df: DataFrame, component: str, document: Column) -> DataFrame:
    return df.select("entity_id", F.lit(component).alias("component"), sha256(document).alias("digest"))


def submission_leaves(submissions: DataFrame) -> DataFrame:
    return _leaves(submissions, COMPONENTS[0], json_object(
        submission_id=json_text("submission_id"),
        file_name=json_text("file_name"),
        sha256_hash=json_text("sha256_hash"),
        row_count=json_number("row_count"),
        minio_path=json_text("path"),
    ))


def quarantine_leaves(rows: DataFrame) -> DataFrame:
    return _leaves(rows, COMPONENTS[1], json_object(
        quarantine_id=json_text("quarantine_id"),
        submission_id=json_text("submission_id"),
        row_index=json_number("row_index"),
        failure_reason=json_text("failure_reason"),
        failed_fields=json_array("failed_fields", sort=True),
        raw_content=json_map("raw_content"),
    ))


def event_leaves(events: DataFrame, timespec: str = "auto") -> DataFrame:
    """`timespec` is that of Python's isoformat: whole seconds are written without microseconds unless told otherwise."""
    return _leaves(events, COMPONENTS[2], json_object(
        **{
            name: json_text(name)
            for name in (
                "event_id", "submission_id", "dataset_type", "standard_event_type", "asset_id",
                "action", "status", "severity", "raw_ref_id",
            )
        },
        event_timestamp=json_text(_iso("event_timestamp", timespec)),
        normalized_payload=json_map("normalized_payload"),
    ))


def gap_leaves(findings: DataFrame) -> DataFrame:
    return _leaves(findings, COMPONENTS[3], json_object(
        component=F.lit('"execution_gap"'),
        finding_id=json_text("finding_id"),
        rule_id=json_text("rule_id"),
        severity=json_text("severity"),
        metric_values=json_map("metric_values"),
        evidence_record_ids=json_array("evidence_record_ids", sort=True),
    ))


def absence_leaves(findings: DataFrame) -> DataFrame:
    return _leaves(findings, COMPONENTS[3], json_object(
        component=F.lit('"negative_space"'),
        finding_id=json_text("finding_id"),
        check_id=json_text("check_id"),
        severity=json_text("severity"),
        expected_volume=_r4("expected_volume"),
        observed_volume=_r4("observed_volume"),
        drop_percentage=_r4("drop_percentage"),
        entropy_score=_r4("entropy_score"),
    ))


def correlation_leaves(edges: DataFrame) -> DataFrame:
    return _leaves(edges, COMPONENTS[3], json_object(
        component=F.lit('"correlation"'),
        correlation_id=json_text("correlation_id"),
        correlation_type=json_text("correlation_type"),
        primary_event_id=json_text("primary_event_id"),
        correlated_event_id=json_text("correlated_event_id"),
        similarity_score=_r4("similarity_score"),
    ))


def score_leaves(scores: DataFrame) -> DataFrame:
    return _leaves(scores, COMPONENTS[3], json_object(
        component=F.lit('"risk_score"'),
        score_id=json_text("score_id"),
        composite_risk_score=_r4("composite_risk_score"),
        execution_gap_score=_r4("execution_gap_score"),
        negative_space_score=_r4("negative_space_score"),
        peer_deviation_score=_r4("peer_deviation_score"),
    ))


LEAVES = {
    "submissions": submission_leaves,
    "quarantine": quarantine_leaves,
    "events": event_leaves,
    "gaps": gap_leaves,
    "absences": absence_leaves,
    "correlations": correlation_leaves,
    "scores": score_leaves,
}
SLICE_TIME = {"submissions": "uploaded_at", "quarantine": "quarantined_at", "events": "event_timestamp"}


def slice_table(name: str, df: DataFrame, period: Period, submission_id: str | None = None) -> DataFrame:
    """Rows a manifest covers: by submission or by time; findings and scores lie inside the period;
    correlations are not restricted."""
    start, end = period.columns()
    if name in SLICE_TIME:
        if submission_id is not None:
            return df.where(F.col("submission_id") == submission_id)
        return df.where(F.col(SLICE_TIME[name]).between(start, end))
    if name == "correlations":
        return df
    return df.where((F.col("period_start") >= start) & (F.col("period_end") <= end))


def subtree_roots(
    tables: dict[str, DataFrame], period: Period, submission_id: str | None = None, timespec: str = "auto"
) -> DataFrame:
    """(entity, component, leaf_count, root) of the non-empty subtrees."""
    leaves = {**LEAVES, "events": partial(event_leaves, timespec=timespec)}
    parts = [leaves[name](slice_table(name, df, period, submission_id)) for name, df in tables.items()]
    return merkle_roots(reduce(DataFrame.unionByName, parts), ["entity_id", "component"])


def build_manifests(
    entities: DataFrame,
    tables: dict[str, DataFrame],
    period: Period,
    generated_at: datetime,
    submission_id: str | None = None,
    manifest_type: str = "PERIOD_AUDIT",
    timespec: str = "auto",
) -> DataFrame:
    """One manifest per entity: four subtree roots (empty ones included), composite root, counts."""
    roots = subtree_roots(tables, period, submission_id, timespec)
    per_entity = roots.groupBy("entity_id").agg(
        *[
            F.max(F.when(F.col("component") == name, F.col("root"))).alias(name) for name in COMPONENTS
        ],
        F.sum(F.when(F.col("component") == COMPONENTS[0], F.col("leaf_count"))).alias("file_count"),
        F.sum(F.when(F.col("component") == COMPONENTS[1], F.col("leaf_count"))).alias("quarantine_count"),
        F.sum(F.when(F.col("component") == COMPONENTS[2], F.col("leaf_count"))).alias("event_count"),
    )
    findings = [
        slice_table(name, tables[name], period).select("entity_id") for name in ("gaps", "absences") if name in tables
    ]
    df = entities.select("entity_id", "entity_code").join(per_entity, "entity_id", "left")
    if findings:
        counts = reduce(DataFrame.unionByName, findings).groupBy("entity_id").agg(F.count("*").alias("finding_count"))
        df = df.join(counts, "entity_id", "left")
    else:
        df = df.withColumn("finding_count", F.lit(0))
    df = df.na.fill({name: EMPTY_DIGEST for name in COMPONENTS}).na.fill(
        0, ["file_count", "quarantine_count", "event_count", "finding_count"]
    )
    start, end = period.columns()
    generated = F.lit(generated_at).cast("timestamp")
    manifest_id = stable_id(F.lit("manifest"), "entity_id", start, end, F.lit(submission_id or ""), generated)
    return df.select(
        manifest_id.alias("manifest_id"),
        "entity_id", "entity_code",
        F.lit(submission_id).cast("string").alias("submission_id"),
        start.alias("period_start"), end.alias("period_end"),
        F.lit(manifest_type).alias("manifest_type"),
        F.lit("1.0.0").alias("manifest_version"),
        F.lit("SHA-256").alias("algorithm"),
        composite_root(*COMPONENTS).alias("root_merkle_sha256"),
        F.struct(*COMPONENTS).alias("component_hashes"),
        "file_count", "quarantine_count", "event_count", "finding_count",
        generated.alias("generated_at"),
    )


def verify_manifests(
    stored: DataFrame, entities: DataFrame, tables: dict[str, DataFrame], period: Period, submission_id: str | None = None,
    timespec: str = "auto",
) -> DataFrame:
    """Recompute the roots and list every difference: VERIFIED or TAMPER_DETECTED; `timespec` is that of the sealing."""
    fresh = build_manifests(entities, tables, period, datetime(1970, 1, 1), submission_id, timespec=timespec).select(
        "entity_id",
        F.col("component_hashes").alias("fresh"),
        F.col("root_merkle_sha256").alias("recomputed_root_sha256"),
    )
    labels = {
        COMPONENTS[0]: "Raw submissions subtree",
        COMPONENTS[1]: "Quarantined records subtree",
        COMPONENTS[2]: "Normalized events subtree",
        COMPONENTS[3]: "Findings and scores subtree",
    }

    def difference(label: str, old: Column, new: Column) -> Column:
        return F.when(
            ~old.eqNullSafe(new), F.format_string(f"{label} mismatch: stored=%s, recomputed=%s", old, new)
        )

    checks = [difference(labels[n], F.col(f"component_hashes.{n}"), F.col(f"fresh.{n}")) for n in COMPONENTS]
    checks.append(difference("Root Merkle hash", F.col("root_merkle_sha256"), F.col("recomputed_root_sha256")))
    found = F.array_compact(F.array(*checks))
    return stored.join(fresh, "entity_id", "left").select(
        "manifest_id", "entity_id",
        (F.size(found) == 0).alias("is_valid"),
        F.when(F.size(found) == 0, "VERIFIED").otherwise("TAMPER_DETECTED").alias("status"),
        F.col("root_merkle_sha256").alias("stored_root_sha256"),
        "recomputed_root_sha256",
        found.alias("discrepancies"),
    )


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """Newest manifest per entity."""
    newest = F.max_by(F.struct(*manifests.columns), F.struct("generated_at", "manifest_id")).alias("m")
    return manifests.groupBy("entity_id").agg(newest).select("m.*")
