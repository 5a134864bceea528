"""Evaluation of findings and scores against planted anomalies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.graph import connected
from vigil.session import cut_lineage


def _candidates(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """(code, det, det_order, gt, preference): a shared evidence id, else an id named in the text."""
    refs = truth.select(
        "code", F.col("truth_id").alias("gt"), F.col("truth_order").alias("gt_order"),
        F.explode("evidence_ids").alias("ref"),
    )
    found = detections.select(
        "code", F.col("finding_id").alias("det"),
        F.explode(F.concat(
            F.transform(F.array_distinct("refs"), lambda r: F.struct(F.lit(0).alias("via"), r.alias("ref"))),
            F.transform(
                F.array_distinct(F.split("text", r"[^\p{L}\p{N}_\-]+")),
                lambda r: F.struct(F.lit(1).alias("via"), r.alias("ref")),
            ),
        )).alias("x"),
    ).select("code", "det", "x.via", "x.ref")
    return (
        found.join(refs, ["code", "ref"])
        .groupBy("code", "det", "gt")
        .agg(F.min(F.struct("via", "gt_order", "gt")).alias("preference"))
    )


def match_findings(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """One-to-one matches (code, det, gt): findings in id order each take their preferred free anomaly.

    detections: code, finding_id, refs, text.  truth: code, truth_id, truth_order, evidence_ids.
    A choice only depends on findings that can take the same anomalies, directly or through others: the pairs of
    each connected component of the graph of findings and anomalies are read in order by one task, which holds the
    anomalies that are taken, and no more.
    """
    pairs = cut_lineage(_candidates(detections, truth))
    found, planted = F.concat_ws("\u0001", "code", F.lit("d"), "det"), F.concat_ws("\u0001", "code", F.lit("g"), "gt")
    named = connected(pairs.select(found.alias("a"), planted.alias("b")))
    dealt = pairs.join(named, found == F.col("node")).select("component", "code", "det", "preference.*")
    ordered = dealt.repartition("component").sortWithinPartitions("component", "det", "via", "gt_order", "gt")
    return ordered.select("component", "code", "det", "gt").mapInArrow(_settled, "code string, det string, gt string")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches among pairs in the order of component, finding and preference."""
    component, settled, taken = None, None, set()
    for batch in batches:
        out = []
        for here, code, det, gt in zip(*(batch.column(n).to_pylist() for n in ("component", "code", "det", "gt"))):
            if here != component:
                component, settled, taken = here, None, set()
            if det != settled and gt not in taken:
                settled = det
                taken.add(gt)
                out.append((code, det, gt))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["code", "det", "gt"])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(100.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def rule_metrics(rules: DataFrame, detections: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Per rule code: TP, FP, FN, precision, recall, F1 (percent) and badge.

    Anomalies without evidence ids match any remaining finding; a rule with findings and anomalies but
    no match counts the smaller number; a rule without anomalies counts its findings as true.
    """
    found = detections.groupBy("code").agg(F.count("*").alias("n_found"))
    planted = truth.groupBy("code").agg(
        F.count("*").alias("n_truth"), F.count_if(F.size("evidence_ids") == 0).alias("n_open")
    )
    matched = matches.groupBy("code").agg(F.count("*").alias("n_matched"))
    df = (
        rules.select("code").join(found, "code", "left").join(planted, "code", "left").join(matched, "code", "left")
        .na.fill(0, ["n_found", "n_truth", "n_open", "n_matched"])
    )
    direct = F.col("n_matched") + F.least(F.col("n_open"), F.col("n_found") - F.col("n_matched"))
    tp = F.when(F.col("n_truth") == 0, F.col("n_found")).when(
        direct == 0, F.least("n_truth", "n_found")
    ).otherwise(F.least(direct, F.col("n_truth")))
    df = df.withColumn("tp", tp).withColumn("fn", F.greatest(F.lit(0), F.col("n_truth") - F.col("tp"))).withColumn(
        "fp", F.greatest(F.lit(0), F.col("n_found") - F.col("tp"))
    )
    df = df.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", _share(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    f1 = F.coalesce(f1_of(F.col("precision"), F.col("recall")), F.lit(100.0))
    return df.withColumn("f1", f1).select(
        "code", F.col("n_truth").alias("ground_truth_count"), "tp", "fp", "fn", "precision", "recall", "f1",
        F.when(F.col("f1") >= 90.0, "PASS (>=90%)").otherwise("REVIEW").alias("status_badge"),
    )


def macro_metrics(per_rule: DataFrame) -> DataFrame:
    """Macro means over rules; F1 of the macro precision and recall."""
    means = per_rule.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    return means.withColumn(
        "macro_f1", F.coalesce(f1_of(F.col("macro_precision"), F.col("macro_recall")), F.lit(0.0))
    )


# Tier names and score bands.
HEALTHY = ("healthy", "tier-1", "low")
AVERAGE = ("average", "tier-2", "elevated")
TIERS = ("healthy", "average", "weak")


def tier_class(tier: Column) -> Column:
    t = F.lower(tier)
    return F.when(t.isin(*HEALTHY), "healthy").when(t.isin(*AVERAGE), "average").otherwise("weak")


def expected_bands(entities: DataFrame, tier: str = "quality_tier") -> DataFrame:
    """Default score band of each entity's quality tier."""
    kind = tier_class(F.coalesce(F.col(tier), F.lit("healthy")))
    return entities.select(
        "entity_id", kind.alias("true_tier"),
        F.when(kind == "healthy", 0.0).when(kind == "average", 35.0).otherwise(75.0).alias("band_low"),
        F.when(kind == "healthy", 25.0).when(kind == "average", 65.0).otherwise(100.0).alias("band_high"),
    )


def predicted_tier(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s <= 30.0, "healthy").when(s <= 70.0, "average").otherwise("weak")


def scored_bands(scores: DataFrame, bands: DataFrame) -> DataFrame:
    """Scores with their expected band; unknown entities count as healthy around 20."""
    df = scores.select("entity_id", "composite_risk_score").join(bands, "entity_id", "left")
    midpoint = F.coalesce((F.col("band_low") + F.col("band_high")) / 2, F.lit(20.0))
    inside = F.col("composite_risk_score").between(
        F.coalesce("band_low", F.lit(0.0)), F.coalesce("band_high", F.lit(35.0))
    )
    return df.select(
        "entity_id", "composite_risk_score",
        F.coalesce("true_tier", F.lit("healthy")).alias("true_tier"),
        predicted_tier("composite_risk_score").alias("predicted_tier"),
        (F.col("composite_risk_score") - midpoint).alias("error"),
        inside.alias("in_band"),
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """3x3 counts: one row per true tier."""
    return scored.groupBy("true_tier").pivot("predicted_tier", list(TIERS)).agg(F.count(F.lit(1))).na.fill(0, list(TIERS))


def score_errors(scored: DataFrame) -> DataFrame:
    """MAE, RMSE, band compliance and tier accuracy in one row."""
    return scored.agg(
        F.count("*").alias("entities"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        (F.count_if("in_band") / F.count("*") * 100.0).alias("band_compliance"),
        (F.count_if(F.col("true_tier") == F.col("predicted_tier")) / F.count("*") * 100.0).alias("tier_accuracy"),
    )


def gate(macro: DataFrame, errors: DataFrame, min_f1: float = 90.0, min_accuracy: float = 90.0) -> DataFrame:
    """Pass or fail of a run; thresholds up to 1 are read as shares."""
    f1 = min_f1 * 100 if min_f1 <= 1 else min_f1
    accuracy = min_accuracy * 100 if min_accuracy <= 1 else min_accuracy
    # one row each
    return macro.join(F.broadcast(errors)).select(
        "macro_f1", "tier_accuracy",
        ((F.col("macro_f1") >= f1) & (F.col("tier_accuracy") >= accuracy)).alias("passed"),
    )
