"""Rationale cards: one explanatory row per finding, with lineage to raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.scalars import first_of, stable_id
from vigil.schema import SEVERITIES

CARD_COLUMNS = (
    "card_id", "finding_id", "entity_id", "engine_name", "rule_code", "title", "severity",
    "severity_score", "confidence", "summary_narrative", "technical_details", "recommendation",
    "evidence_record_ids", "raw_evidence_refs", "raw_row_indices", "metrics_snapshot",
)


def _text(name: str):
    return F.col(name).cast("string")


def gap_cards(findings: DataFrame) -> DataFrame:
    return findings.select(
        stable_id(F.lit("card"), "finding_id").alias("card_id"),
        "finding_id", "entity_id",
        F.lit("EXECUTION_GAP").alias("engine_name"),
        F.col("rule_id").alias("rule_code"),
        F.col("rule_name").alias("title"),
        "severity", "severity_score", "confidence",
        first_of("rationale", "description").alias("summary_narrative"),
        F.create_map(
            F.lit("condition_evaluated"), F.format_string("Execution Gap Rule %s violated", "rule_id"),
            F.lit("metric_values"), F.to_json("metric_values"),
            F.lit("evidence_count"), _text("evidence_count"),
        ).alias("technical_details"),
        F.coalesce("recommendation", F.lit("Review and remediate compliance gap.")).alias("recommendation"),
        "evidence_record_ids", "raw_evidence_refs", "raw_row_indices",
        F.col("metric_values").alias("metrics_snapshot"),
    )


def absence_cards(findings: DataFrame) -> DataFrame:
    metrics = F.create_map(
        F.lit("expected_volume"), _text("expected_volume"),
        F.lit("observed_volume"), _text("observed_volume"),
        F.lit("drop_percentage"), _text("drop_percentage"),
        F.lit("entropy_score"), _text("entropy_score"),
    )
    return findings.select(
        stable_id(F.lit("card"), "finding_id").alias("card_id"),
        "finding_id", "entity_id",
        F.lit("NEGATIVE_SPACE").alias("engine_name"),
        F.col("check_id").alias("rule_code"),
        F.col("check_name").alias("title"),
        "severity", "severity_score", "confidence",
        F.col("rationale").alias("summary_narrative"),
        F.create_map(
            F.lit("condition_evaluated"), F.format_string("Absence check %s anomaly threshold breached", "check_id"),
            F.lit("threshold_value"), _text("expected_volume"),
            F.lit("observed_value"), _text("observed_volume"),
            F.lit("drop_percentage"), _text("drop_percentage"),
            F.lit("entropy_score"), _text("entropy_score"),
        ).alias("technical_details"),
        F.coalesce("recommendation", F.lit("Investigate missing telemetry or activity logs.")).alias("recommendation"),
        "evidence_record_ids",
        F.array().cast("array<string>").alias("raw_evidence_refs"),
        F.array().cast("array<bigint>").alias("raw_row_indices"),
        F.map_filter(metrics, lambda _, v: v.isNotNull()).alias("metrics_snapshot"),
    )


def with_lineage(cards: DataFrame, events: DataFrame) -> DataFrame:
    """Fill missing raw row indices of gap cards from their inline evidence events."""
    missing = cards.where((F.col("engine_name") == "EXECUTION_GAP") & (F.size("raw_row_indices") == 0))
    traced = (
        missing.select("card_id", "entity_id", F.explode("evidence_record_ids").alias("event_id"))
        .join(events.select("entity_id", "event_id", "raw_row_index"), ["entity_id", "event_id"])
        .where(F.col("raw_row_index").isNotNull())
        .groupBy("card_id")
        .agg(F.array_sort(F.collect_set("raw_row_index")).alias("traced"))
    )
    return cards.join(traced, "card_id", "left").withColumn(
        "raw_row_indices", F.coalesce("traced", "raw_row_indices")
    ).select(*CARD_COLUMNS)


def rationale_cards(gaps: DataFrame, absences: DataFrame, events: DataFrame | None = None) -> DataFrame:
    cards = gap_cards(gaps).unionByName(absence_cards(absences))
    return cards if events is None else with_lineage(cards, events)


def shared_cards(cards: DataFrame) -> DataFrame:
    """Public card view; unknown severities read as HIGH."""
    return cards.select(
        "title",
        F.col("engine_name").alias("category"),
        F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("HIGH").alias("severity"),
        F.col("summary_narrative").alias("rationale_text"),
        "evidence_record_ids", "raw_evidence_refs",
        F.col("metrics_snapshot").alias("metric_values"),
        F.col("recommendation").alias("recommended_action"),
    )
