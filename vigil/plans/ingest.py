"""From submitted files to canonical events, quarantined rows and submission status."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import stable_id
from vigil.operators.mapping import active_profiles, normalize
from vigil.operators.validation import quarantined_rows, submission_status, valid_rows, validate
from vigil.sources.formats import classify_dataset, header_tokens
from vigil.sources.readers import file_digests, file_heads, read_lines, read_submissions


@dataclass(frozen=True)
class Ingested:
    events: DataFrame
    quarantine: DataFrame
    submissions: DataFrame


def ingest_rows(
    rows: DataFrame,
    submissions: DataFrame,
    ingested_at: datetime,
    profiles: DataFrame | None = None,
    date_formats: tuple[str, ...] = (),
) -> Ingested:
    """Validate, split and normalise parsed rows carrying submission_id, entity_id and dataset_type."""
    mapping = None
    if profiles is not None:
        rules = active_profiles(profiles).select("entity_id", "dataset_type", F.col("rules").alias("profile_rules"))
        rows = rows.join(rules, ["entity_id", "dataset_type"], "left")
        mapping = "profile_rules"
    validated = validate(rows, mapping)
    return Ingested(
        events=normalize(valid_rows(validated), ingested_at, profiles, date_formats),
        quarantine=quarantined_rows(validated, ingested_at),
        submissions=submission_status(validated, submissions),
    )


def register_files(spark: SparkSession, path: str, uploaded_at: datetime) -> DataFrame:
    """Submission rows of the files under `path`, with the detected dataset type of each."""
    heads = (
        file_heads(read_lines(spark, path))
        .withColumn("tokens", header_tokens(F.array_join("head", "\n")))
        .select("file", classify_dataset("file", "tokens").alias("d"))
    )
    return file_digests(spark, path).join(heads, "file", "left").select(
        stable_id(F.lit("submission"), "file", "sha256_hash").alias("submission_id"),
        "file",
        F.element_at(F.split("file", "/"), -1).alias("file_name"),
        F.col("file").alias("path"),
        "sha256_hash", "size",
        F.col("d.dataset_type").alias("dataset_type"),
        F.col("d.confidence").alias("confidence"),
        F.lit(uploaded_at).cast("timestamp").alias("uploaded_at"),
    )


def ingest_files(
    spark: SparkSession,
    path: str,
    submissions: DataFrame,
    ingested_at: datetime,
    profiles: DataFrame | None = None,
    format: str = "auto",
    date_formats: tuple[str, ...] = (),
) -> Ingested:
    """Read all files under `path`; `submissions` names file, submission_id, entity_id and dataset_type."""
    keys = submissions.select("file", "submission_id", "entity_id", "dataset_type")
    rows = read_submissions(spark, path, format).join(keys, "file").drop("file")
    return ingest_rows(rows, submissions, ingested_at, profiles, date_formats)
