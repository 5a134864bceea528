"""Risk scores: weighted sub-scores, tier, trend and narrative."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.functions.scalars import clamp, risk_tier, stable_id, trend
from vigil.operators.execution_gaps import Period

WEIGHTS = {"execution_gap": 0.45, "negative_space": 0.35, "peer_deviation": 0.20}  # fixed values


def gap_subscores(findings: DataFrame, alert_counts: DataFrame) -> DataFrame:
    """Execution-gap score: severity x confidence, scaled down with the alert volume."""
    sums = findings.groupBy("entity_id").agg(
        F.sum(F.col("severity_score") / 100.0 * F.col("confidence")).alias("s"), F.count("*").alias("gap_count")
    )
    scale = F.greatest(F.lit(15.0), F.log10(F.greatest(F.lit(0), F.coalesce("alerts", F.lit(0))) + 10.0) * 10.0)
    return sums.join(alert_counts, "entity_id", "left").select(
        "entity_id", "gap_count",
        F.round(clamp(F.col("s") * (100.0 / scale), 0.0, 100.0), 2).alias("execution_gap_score"),
    )


def absence_subscores(findings: DataFrame) -> DataFrame:
    weighted = F.col("severity_score") / 100.0 * F.col("confidence") * F.col("degradation_factor") * 20.0
    return findings.groupBy("entity_id").agg(
        F.round(clamp(F.sum(weighted), 0.0, 100.0), 2).alias("negative_space_score"),
        F.count("*").alias("absence_count"),
    )


def composite(gap: Column, absence: Column, peer: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    total = weights["execution_gap"] * gap + weights["negative_space"] * absence + weights["peer_deviation"] * peer
    return F.round(clamp(total, 0.0, 100.0), 2)


def narrative() -> Column:
    drivers = F.concat_ws(
        ", ",
        F.when(F.col("execution_gap_score") >= 50.0, F.format_string("%s execution gaps detected", "gap_count")),
        F.when(
            F.col("negative_space_score") >= 50.0,
            F.format_string("%s negative space absence anomalies detected", "absence_count"),
        ),
        F.when(
            F.col("peer_deviation_score") >= 60.0,
            F.lit("statistically significant negative deviation from sector peer cohort"),
        ),
    )
    head = F.format_string(
        "Composite Risk Score: %s/100 (%s Tier). Component breakdown: Execution Gap = %s (weight 45%%), "
        "Negative Space = %s (weight 35%%), Peer Deviation = %s (weight 20%%).",
        "composite_risk_score", "risk_tier", "execution_gap_score", "negative_space_score", "peer_deviation_score",
    )
    tail = F.when(drivers != "", F.concat(F.lit(" Primary risk drivers: "), drivers, F.lit("."))).otherwise(
        F.lit(" Risk indicators remain within nominal supervisory tolerances.")
    )
    return F.concat(head, tail)


def risk_scores(
    entities: DataFrame,
    alert_counts: DataFrame,
    gap_findings: DataFrame,
    absence_findings: DataFrame,
    peers: DataFrame,
    period: Period,
    calculated_at: datetime,
    previous: DataFrame | None = None,
    weights: dict[str, float] = WEIGHTS,
) -> DataFrame:
    """One score row per entity. `previous` holds (entity_id, previous_score) where known."""
    start, end = period.columns()
    df = (
        entities.select("entity_id")
        .join(gap_subscores(gap_findings, alert_counts), "entity_id", "left")
        .join(absence_subscores(absence_findings), "entity_id", "left")
        .join(peers.select("entity_id", "peer_deviation_score"), "entity_id", "left")
        .na.fill({"execution_gap_score": 0.0, "negative_space_score": 0.0, "gap_count": 0, "absence_count": 0, "peer_deviation_score": 50.0})
        .withColumn("peer_deviation_score", clamp(F.col("peer_deviation_score"), 0.0, 100.0))
        .withColumn(
            "composite_risk_score",
            composite(F.col("execution_gap_score"), F.col("negative_space_score"), F.col("peer_deviation_score"), weights),
        )
        .withColumn("risk_tier", risk_tier("composite_risk_score"))
    )
    if previous is not None:
        df = df.join(previous, "entity_id", "left")
    else:
        df = df.withColumn("previous_score", F.lit(None).cast("double"))
    calculated = F.lit(calculated_at).cast("timestamp")
    return df.select(
        stable_id(F.lit("score"), "entity_id", start, end, calculated).alias("score_id"),
        "entity_id",
        start.alias("period_start"), end.alias("period_end"),
        "composite_risk_score", "execution_gap_score", "negative_space_score", "peer_deviation_score",
        "risk_tier",
        trend("composite_risk_score", "previous_score").alias("trend_direction"),
        F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]).alias("weights_applied"),
        narrative().alias("rationale_summary"),
        calculated.alias("calculated_at"),
    )


def sliced_lag(df: DataFrame, keys: list[str], slice_by: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Previous value in `order` per key, without bringing a key's rows into one task.

    Rows are compared inside slices of the order; the first row of a slice takes the last value of the
    slice before it from a table with one row per slice.
    """
    sliced = df.withColumn("_slice", slice_by)
    part = [*keys, "_slice"]
    inside = W.partitionBy(*part).orderBy(*order)
    ends = sliced.groupBy(*part).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = ends.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    return (
        sliced.withColumn(out, F.lag(value).over(inside))
        .withColumn("_is_first", F.row_number().over(inside) == 1)
        .join(before, part)
        .withColumn(out, F.when(F.col("_is_first"), F.col("_before")).otherwise(F.col(out)))
        .drop("_slice", "_before", "_is_first")
    )


def score_trends(scores: DataFrame) -> DataFrame:
    """Trend of every score against the entity's previous one; a run appends one row per entity."""
    month = F.date_trunc("month", F.col("calculated_at"))
    lagged = sliced_lag(
        scores, ["entity_id"], month, ["calculated_at", "score_id"], "composite_risk_score", "_previous"
    )
    return lagged.withColumn("trend_direction", trend("composite_risk_score", "_previous")).drop("_previous")
