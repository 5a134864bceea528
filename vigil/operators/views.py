"""Serving views: summary, worklist, entity and finding lists, cohort views, report documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from vigil.operators.risk import WEIGHTS

NEWEST_SCORE = ("calculated_at", "score_id")


def page(df: DataFrame, *order: Column | str, offset: int = 0, limit: int = 100) -> DataFrame:
    """Ordered slice of a listing; a limit this small runs as a top-k, not as a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """Row with the greatest `newest` values per key; combines map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("r")).select(key, "r.*")


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per(scores, "entity_id", *NEWEST_SCORE)


def open_findings(gaps: DataFrame, absences: DataFrame) -> DataFrame:
    """Open gap findings plus all absence findings, per entity."""
    rows = gaps.where(F.col("status") == "OPEN").select("entity_id").unionByName(absences.select("entity_id"))
    return rows.groupBy("entity_id").agg(F.count("*").alias("open_findings_count"))


def executive_summary(
    entities: DataFrame, scores: DataFrame, gaps: DataFrame, absences: DataFrame, submissions: DataFrame
) -> DataFrame:
    """One row of key figures. An entity at exactly 75.0 counts as critical and as elevated."""
    score, tier = F.col("composite_risk_score"), F.col("risk_tier")
    parts = [
        entities.agg(F.count("*").alias("total_entities")),
        latest_scores(scores).agg(
            F.count_if((tier == "CRITICAL") | (score >= 75.0)).alias("critical_risk_entities"),
            F.count_if(tier.isin("ELEVATED", "HIGH") | ((score >= 50.0) & (score < 75.0))).alias("elevated_risk_entities"),
            F.coalesce(F.round(F.avg(score), 2), F.lit(0.0)).alias("average_risk_score"),
        ),
        gaps.agg(F.count_if(F.col("status") == "OPEN").alias("active_gap_findings")),
        absences.agg(F.count("*").alias("active_silence_findings")),
        submissions.agg(
            F.count("*").alias("total_submissions"),
            F.coalesce(F.sum("quarantined_row_count"), F.lit(0)).alias("total_quarantined_rows"),
        ),
    ]
    # one row each: the product is one row
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    return out


def sparklines(scores: DataFrame, points: int = 10) -> DataFrame:
    """Last ten scores per entity, oldest first; ranks are cut before the shuffle."""
    newest = W.partitionBy("entity_id").orderBy(F.desc("calculated_at"), F.desc("score_id"))
    return (
        scores.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= points)
        .groupBy("entity_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("o"), F.col("composite_risk_score").alias("v")))).alias("s"))
        .select("entity_id", F.transform("s", lambda x: x["v"]).alias("sparkline"))
    )


def worklist(
    entities: DataFrame,
    scores: DataFrame,
    gaps: DataFrame,
    absences: DataFrame,
    submissions: DataFrame,
    sector: str | None = None,
    size_tier: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Active entities by descending risk."""
    active = entities.where(F.col("is_active"))
    if sector:
        active = active.where(F.col("sector") == sector)
    if size_tier:
        active = active.where(F.col("size_tier") == size_tier)
    current = latest_scores(scores).select(
        "entity_id", "composite_risk_score", "execution_gap_score", "negative_space_score",
        "peer_deviation_score", "risk_tier", "trend_direction",
    )
    uploads = submissions.groupBy("entity_id").agg(F.max("uploaded_at").alias("last_submission_date"))
    df = (
        active.select("entity_id", "entity_code", "name", "sector", "size_tier")
        .join(current, "entity_id", "left")
        .join(open_findings(gaps, absences), "entity_id", "left")
        .join(sparklines(scores), "entity_id", "left")
        .join(uploads, "entity_id", "left")
        .na.fill(0.0, ["composite_risk_score", "execution_gap_score", "negative_space_score", "peer_deviation_score"])
        .na.fill({"risk_tier": "LOW", "trend_direction": "STABLE", "open_findings_count": 0})
        .withColumn("sparkline", F.coalesce("sparkline", F.array(F.lit(0.0))))
    )
    return page(df, F.desc("composite_risk_score"), "entity_id", limit=min(limit, 200))


def entity_list(entities: DataFrame, scores: DataFrame, gaps: DataFrame, absences: DataFrame) -> DataFrame:
    current = latest_scores(scores).select("entity_id", "composite_risk_score", "risk_tier", "trend_direction")
    return (
        entities.join(current, "entity_id", "left")
        .join(open_findings(gaps, absences), "entity_id", "left")
        .na.fill({"open_findings_count": 0})
    )


def score_history(scores: DataFrame, points: int = 30) -> DataFrame:
    """First `points` scores per entity in time order, as chart rows."""
    oldest = W.partitionBy("entity_id").orderBy("calculated_at", "score_id")
    return (
        scores.withColumn("rank", F.row_number().over(oldest))
        .where(F.col("rank") <= points)
        .select(
            "entity_id", F.col("rank").cast("bigint").alias("position"),
            F.date_format("calculated_at", "yyyy-MM-dd").alias("date"),
            F.col("composite_risk_score").alias("composite"),
            F.col("execution_gap_score").alias("execution_gap"),
            F.col("negative_space_score").alias("negative_space"),
            F.col("peer_deviation_score").alias("peer_deviation"),
            F.col("risk_tier").alias("tier"),
        )
    )


# Radar axes with the score they derive from, its factor and the benchmark.
RADAR_AXES = (
    ("Execution Gap", "execution_gap_score", 1.0, 30.0),
    ("Negative Space", "negative_space_score", 1.0, 25.0),
    ("Peer Deviation", "peer_deviation_score", 1.0, 35.0),
    ("Note Plagiarism", "execution_gap_score", 0.8, 20.0),
    ("SLA Breach Rate", "execution_gap_score", 1.1, 28.0),
    ("Sensor Silence", "negative_space_score", 1.2, 22.0),
)
RADAR_DEFAULTS = {"execution_gap_score": 20.0, "negative_space_score": 15.0, "peer_deviation_score": 25.0}


def radar(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Six axes per entity from its latest score."""
    df = entities.select("entity_id").join(
        latest_scores(scores).select("entity_id", *RADAR_DEFAULTS), "entity_id", "left"
    ).na.fill(RADAR_DEFAULTS)
    axes = F.array(
        *[
            F.struct(
                F.lit(axis).alias("axis"),
                F.round(F.col(name) if factor == 1.0 else F.least(F.lit(100.0), F.col(name) * factor), 1).alias("value"),
                F.lit(benchmark).alias("benchmark"),
            )
            for axis, name, factor, benchmark in RADAR_AXES
        ]
    )
    return df.select("entity_id", F.inline(axes))


def unified_findings(entities: DataFrame, gaps: DataFrame, absences: DataFrame) -> DataFrame:
    """Both kinds of findings in one shape, with the entity's name."""
    shape = ["finding_id", "entity_id", "severity", "period_start", "period_end", "rationale", "evidence_record_ids", "evidence_count"]
    g = gaps.select(
        *shape, F.lit("EXECUTION_GAP").alias("engine"), F.col("rule_id").alias("rule_or_check_id"),
        F.col("rule_name").alias("title"), F.col("rule_category").alias("category"), "status", "description",
        F.lit(0.95).alias("confidence"),
    )
    a = absences.select(
        *shape, F.lit("NEGATIVE_SPACE").alias("engine"), F.col("check_id").alias("rule_or_check_id"),
        F.col("check_name").alias("title"), F.col("check_category").alias("category"), F.lit("OPEN").alias("status"),
        F.format_string(
            "Observed volume %s dropped %s%% vs expected baseline %s",
            "observed_volume", "drop_percentage", "expected_volume",
        ).alias("description"),
        F.lit(0.90).alias("confidence"),
    )
    names = entities.select("entity_id", F.col("name").alias("entity_name"))
    return g.unionByName(a).join(names, "entity_id", "left").withColumn(
        "entity_name", F.coalesce("entity_name", F.lit("Unknown Entity"))
    )


# Names under which the two engines are addressed.
ENGINE_ALIASES = {
    "EXECUTION_GAP": "EXECUTION_GAP", "GAP": "EXECUTION_GAP",
    "NEGATIVE_SPACE": "NEGATIVE_SPACE", "SILENCE": "NEGATIVE_SPACE", "ANOMALY": "NEGATIVE_SPACE",
}


def list_findings(
    unified: DataFrame, engine: str | None = None, severity: str | None = None, status: str | None = None,
    entity_id: str | None = None, offset: int = 0, limit: int = 100,
) -> DataFrame:
    """Filtered, merged page. The status filter concerns gap findings only."""
    df = unified
    if engine:
        df = df.where(F.col("engine") == ENGINE_ALIASES.get(engine.upper(), ""))
    if severity:
        df = df.where(F.col("severity") == severity.upper())
    if status:
        df = df.where((F.col("engine") == "NEGATIVE_SPACE") | (F.col("status") == status.upper()))
    if entity_id:
        df = df.where(F.col("entity_id") == entity_id)
    return page(df, F.desc("period_end"), "finding_id", offset=offset, limit=limit)


def grouped_findings(unified: DataFrame) -> DataFrame:
    """One row per kind of violation."""
    return unified.groupBy("rule_or_check_id", "title").agg(
        F.count("*").alias("finding_count"), F.sum("evidence_count").alias("evidence_total")
    )


def search_findings(unified: DataFrame, needle: str) -> DataFrame:
    text = F.lower(F.concat_ws("\n", "title", "rule_or_check_id", "entity_name", "description"))
    return unified.where(F.contains(text, F.lit(needle.lower())))


def evidence_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Events attached to findings: explode the ids, equi join within the entity."""
    ids = findings.select("finding_id", "entity_id", F.explode("evidence_record_ids").alias("event_id")).distinct()
    return ids.join(events, ["entity_id", "event_id"])


def raw_diff(findings: DataFrame, quarantined: DataFrame, newest: int = 10) -> DataFrame:
    """Newest quarantined rows of each finding's entity."""
    order = W.partitionBy("entity_id").orderBy(F.desc("quarantined_at"), F.desc("quarantine_id"))
    recent = (
        quarantined.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= newest)
        .select("entity_id", "quarantine_id", "row_index", "failure_reason", "failed_fields", "raw_content", "rank")
    )
    return findings.select("finding_id", "entity_id").join(recent, "entity_id")


def score_distributions(entities: DataFrame, scores: DataFrame, default: float = 25.0) -> DataFrame:
    """Cohort distribution of latest scores; percentiles by index into the sorted list.

    A cohort holds entities, so its list is bounded by the entity dimension.
    """
    current = latest_scores(scores).select("entity_id", "composite_risk_score", "risk_tier")
    member = F.struct("score", "entity_id", "name", F.coalesce("risk_tier", F.lit("LOW")).alias("tier"))
    cohorts = (
        entities.where(F.col("is_active"))
        .join(current, "entity_id", "left")
        .withColumn("score", F.coalesce("composite_risk_score", F.lit(default)))
        .groupBy("sector", "size_tier")
        .agg(F.array_sort(F.collect_list(member)).alias("entities"), F.avg("score").alias("mean"))
        .withColumn("n", F.size("entities"))
    )

    def at(q: float) -> Column:
        index = F.floor(F.col("n") * F.lit(q)).cast("int")
        return F.round(F.get("entities", index)["score"], 2)

    return cohorts.select(
        "sector", "size_tier", F.col("n").cast("bigint").alias("peer_group_size"),
        F.round("mean", 2).alias("mean_risk_score"),
        at(0.25).alias("p25"), at(0.50).alias("p50"), at(0.75).alias("p75"), at(0.90).alias("p90"),
        (F.col("n") < 3).alias("is_low_confidence"), "entities",
    )


def score_z_scores(entities: DataFrame, scores: DataFrame, sector: str | None = None, default: float = 20.0) -> DataFrame:
    """Population z-score of each entity's latest score within its cohort."""
    active = entities.where(F.col("is_active"))
    if sector:
        active = active.where(F.col("sector") == sector)
    current = latest_scores(scores).select("entity_id", "composite_risk_score")
    cohort = W.partitionBy("sector", "size_tier")
    df = active.join(current, "entity_id", "left").select(
        "entity_id", "entity_code", "name", "sector", "size_tier",
        F.coalesce("composite_risk_score", F.lit(default)).alias("risk_score"),
    ).select(
        "*",
        F.avg("risk_score").over(cohort).alias("mean"),
        F.stddev_pop("risk_score").over(cohort).alias("sd"),
        F.count("*").over(cohort).alias("peer_group_size"),
    ).withColumn(
        "z_score",
        F.when(F.col("sd") > 0.01, F.round((F.col("risk_score") - F.col("mean")) / F.col("sd"), 2)).otherwise(F.lit(0.0)),
    )
    return df.select(
        "entity_id", "entity_code", "name", "sector", "size_tier", "risk_score",
        F.round("mean", 2).alias("sector_mean"), "z_score",
        (F.abs("z_score") >= 2.0).alias("is_outlier"),
        (F.col("peer_group_size") < 3).alias("is_low_confidence"),
        "peer_group_size",
    )


def report_findings(gaps: DataFrame, newest: int = 50, wanted: int = 10, created: str = "period_end") -> DataFrame:
    """Diverse pick per entity from its newest 50 findings: the first of every rule, filled up to 10
    rule by rule."""
    recent_order = W.partitionBy("entity_id").orderBy(F.desc(created), "finding_id")
    rule_order = W.partitionBy("entity_id", "rule_id").orderBy("recency")
    recent = (
        gaps.withColumn("recency", F.row_number().over(recent_order))
        .where(F.col("recency") <= newest)
        .withColumn("in_rule", F.row_number().over(rule_order))
        .withColumn("rule_seen", F.min("recency").over(W.partitionBy("entity_id", "rule_id")))
    )
    pick = W.partitionBy("entity_id").orderBy((F.col("in_rule") > 1).cast("int"), "rule_seen", "in_rule")
    return (
        recent.withColumn("position", F.row_number().over(pick))
        .where((F.col("in_rule") == 1) | (F.col("position") <= wanted))
        .drop("recency", "rule_seen")
    )


def compliance_reports(
    entities: DataFrame, scores: DataFrame, gaps: DataFrame, absences: DataFrame, manifests: DataFrame,
    generated_at: datetime,
) -> DataFrame:
    """One report document per entity."""
    item = ["title", "rule_or_check_id", "engine", "severity", "rationale", "evidence_record_ids"]

    def collected(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("position", F.struct(*item).alias("item"))))
        return df.groupBy("entity_id").agg(rows.alias("r")).select("entity_id", F.transform("r", lambda x: x["item"]).alias(name))

    picked = report_findings(gaps).select(
        "entity_id", "position", F.col("rule_name").alias("title"), F.col("rule_id").alias("rule_or_check_id"),
        F.lit("EXECUTION_GAP").alias("engine"), "severity", "rationale", "evidence_record_ids",
    )
    newest = W.partitionBy("entity_id").orderBy(F.desc("period_end"), "finding_id")
    silent = (
        absences.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= 10)
        .select(
            "entity_id", "position", F.col("check_name").alias("title"), F.col("check_id").alias("rule_or_check_id"),
            F.lit("NEGATIVE_SPACE").alias("engine"), "severity", "rationale", "evidence_record_ids",
        )
    )
    current = latest_scores(scores).select("entity_id", "composite_risk_score", "risk_tier", *RADAR_DEFAULTS)
    sealed = latest_per(manifests, "entity_id", "generated_at", "manifest_id").select(
        "entity_id",
        F.struct(
            "manifest_id", "root_merkle_sha256", "file_count", "event_count", "finding_count", "generated_at",
            F.lit("VERIFIED_TAMPER_PROOF").alias("status"),
        ).alias("audit_manifest"),
    )
    df = (
        entities.join(current, "entity_id", "left")
        .join(collected(picked, "critical_findings"), "entity_id", "left")
        .join(collected(silent, "sensor_silence_findings"), "entity_id", "left")
        .join(sealed, "entity_id", "left")
        .na.fill({"composite_risk_score": 25.0, "risk_tier": "LOW", **RADAR_DEFAULTS})
    )
    n_gaps = F.coalesce(F.size("critical_findings"), F.lit(0))
    n_silent = F.coalesce(F.size("sensor_silence_findings"), F.lit(0))
    summary = F.format_string(
        "Supervisory cyber audit for %s (%s) operating in sector %s (%s). Evaluated risk score: %s/100 (%s). "
        "Detected %s execution gap violations and %s negative space anomalies. "
        "Cryptographic SHA-256 Merkle root generated and verified.",
        F.col("name"), F.col("entity_code"), F.col("sector"), F.col("size_tier"),
        F.col("composite_risk_score"), F.col("risk_tier"), F.greatest(n_gaps, F.lit(0)), F.greatest(n_silent, F.lit(0)),
    )
    return df.select(
        "entity_id",
        F.lit(generated_at).cast("timestamp").alias("generated_at"),
        F.struct("entity_id", "entity_code", "name", "sector", "size_tier").alias("entity"),
        summary.alias("executive_summary"),
        "composite_risk_score", "risk_tier",
        F.struct(
            F.col("execution_gap_score").alias("execution_gap"),
            F.col("negative_space_score").alias("negative_space"),
            F.col("peer_deviation_score").alias("peer_deviation"),
        ).alias("subscores"),
        F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]).alias("weights_applied"),
        "critical_findings", "sensor_silence_findings",
        F.struct(
            "sector", "size_tier", F.col("peer_deviation_score").alias("peer_deviation_subscore"),
            F.lit("HIGH").alias("confidence"),
        ).alias("peer_comparison"),
        "audit_manifest",
    )
