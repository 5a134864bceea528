from datetime import datetime

from helpers import NOW, PERIOD, at
from pyspark.sql import functions as F

from vigil.functions.scalars import risk_tier, trend
from vigil.operators import peers as pr
from vigil.operators.risk import composite
from vigil.plans.analyze import FINDINGS, analyze, persist_run
from vigil.sources.sinks import SCORES
from vigil.sources.snapshots import read_table

SNAPSHOT = "entity_id string, sector string, size_tier string, mtti_minutes double, escalation_rate double, stale_case_ratio double, coverage_gap_ratio double, execution_gap_rate double"


def snapshots(spark, *rows):
    return spark.createDataFrame([(f"e{i}", s, t, m, 0.1, 0.2, 0.0, 1.0) for i, (s, t, m) in enumerate(rows)], SNAPSHOT)


def test_cohort_statistics(spark):
    df = spark.createDataFrame([("c", float(v)) for v in (10, 20, 30, 40, 50)], "g string, v double")
    row = pr.cohort_distribution(df, ["g"], "v").first()
    assert (row.mean_val, row.std_dev, row.p25, row.p50, row.p75, row.p90) == (30.0, 15.8114, 20.0, 30.0, 40.0, 46.0)
    ranks = {r.v: r.percentile for r in pr.percentile_ranks(df, ["g"], "v").collect()}
    assert (ranks[10.0], ranks[30.0], ranks[50.0]) == (10.0, 50.0, 90.0)


def test_close_values_share_a_rank(spark):
    values = [1000.0, 1000.009, 1000.02, 0.5, 0.500009, -3.0]
    df = spark.createDataFrame([("c", v) for v in values], "g string, v double")

    def close(a, b):
        return abs(a - b) <= max(1e-5 * max(abs(a), abs(b)), 1e-5)

    for r in pr.percentile_ranks(df, ["g"], "v").collect():
        want = (sum(x < r.v for x in values) + 0.5 * sum(close(x, r.v) for x in values)) / len(values) * 100
        assert r.percentile == round(want, 2), r


def test_cohort_fallback(spark):
    def levels(*rows):
        return {r.entity_id: (r.fallback_applied, r.peer_group_size, r.dampening_factor) for r in pr.choose_cohorts(snapshots(spark, *rows)).collect()}

    assert levels(("Banking", "Tier-1", 1.0))["e0"] == ("BASELINE_FALLBACK", 1, 0.5)
    assert levels(*[("Banking", "Tier-1", 1.0)] * 3)["e0"] == ("EXACT_COHORT", 3, 1.0)
    assert levels(*[("Banking", f"Tier-{i}", 1.0) for i in range(3)])["e0"] == ("SECTOR_FALLBACK", 3, 0.5)
    assert levels(("Banking", "T", 1.0), ("Energy", "T", 1.0), ("Telecom", "T", 1.0))["e0"] == ("GLOBAL_FALLBACK", 3, 0.5)


def test_exact_cohort_and_baseline_benchmarks(spark):
    rows = pr.benchmark_entities(snapshots(spark, *[("Banking", "Tier-1", m) for m in (10.0, 20.0, 60.0)]))
    got = {r.entity_id: r for r in rows.where("metric_name = 'mtti_minutes'").collect()}
    assert (got["e2"].mean_val, got["e2"].std_dev, got["e2"].z_score, got["e2"].percentile) == (30.0, 26.4575, 1.1339, 83.33)
    alone = pr.benchmark_entities(snapshots(spark, ("Energy", "Tier-1", 85.0)))
    row = alone.where("metric_name = 'mtti_minutes'").first()
    assert (row.mean_val, row.z_score, row.percentile, round(row.p90, 2)) == (60.0, 1.0, 100.0, 92.0)
    score = pr.peer_evaluations(alone).first()
    assert score.fallback_applied == "BASELINE_FALLBACK" and 0 <= score.peer_deviation_score <= 100


def test_metric_snapshot(spark, make_events):
    entities = spark.createDataFrame([("B", "BANK", "Bank", "Banking", "Tier-1", True), ("Z", "Z", "Z", "Energy", "Tier-2", True)],
                                     "entity_id string, entity_code string, name string, sector string, size_tier string, is_active boolean")
    events = make_events(
        dict(kind="ALERT", raw_ref_id="A1", event_timestamp=at(10)),
        dict(kind="ALERT", raw_ref_id="A2", event_timestamp=at(9)),
        dict(kind="INVESTIGATION", alert_id="A1", event_timestamp=at(10 - 1 / 3)),
        dict(kind="ESCALATION", case_id="C1", event_timestamp=at(8)),
        dict(kind="CASE", raw_ref_id="C1", status="OPEN", event_timestamp=at(80)),
        dict(kind="CASE", raw_ref_id="C2", status="CLOSED", event_timestamp=at(80)),
        dict(kind="ASSET", asset_id="S1", criticality_tier="CROWN_JEWEL"),
    )
    findings = spark.createDataFrame([("B",)], "entity_id string")
    rows = {r.entity_id: r for r in pr.entity_metrics(entities, events, findings, NOW).collect()}
    b = rows["B"]
    assert (b.mtti_minutes, b.escalation_rate, b.stale_case_ratio, b.coverage_gap_ratio, b.execution_gap_rate) == (20.0, 0.5, 0.5, 1.0, 50.0)
    assert (rows["Z"].mtti_minutes, rows["Z"].escalation_rate) == (45.0, 0.0)
    assert pr.entity_metrics(entities, events, None, datetime(2026, 8, 22), parity=True).where("entity_id = 'B'").first().stale_case_ratio == 0.5


def test_composite_tiers_and_trends(spark):
    df = spark.createDataFrame([(50.0, 50.0, 50.0), (100.0, 0.0, 0.0), (900.0, 900.0, 900.0), (-5.0, 0.0, 0.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(composite(F.col("a"), F.col("b"), F.col("c"))).collect()] == [50.0, 45.0, 100.0, 0.0]
    scores = spark.createDataFrame([(x,) for x in (25.0, 25.01, 50.0, 50.01, 75.0, 75.01)], "s double")
    assert [r[0] for r in scores.select(risk_tier("s")).collect()] == ["LOW", "GUARDED", "GUARDED", "ELEVATED", "ELEVATED", "CRITICAL"]
    moves = spark.createDataFrame([(52.0, 50.0), (52.1, 50.0), (48.0, 50.0), (47.9, 50.0), (1.0, None)], "c double, p double")
    assert [r[0] for r in moves.select(trend("c", "p")).collect()] == ["STABLE", "DETERIORATING", "STABLE", "IMPROVING", "STABLE"]


def test_full_run_persists_and_repeats(spark, make_events, tmp_path):
    entities = spark.createDataFrame([("B", "BANK", "Bank", "Banking", "Tier-1", True)],
                                     "entity_id string, entity_code string, name string, sector string, size_tier string, is_active boolean")
    events = make_events(
        dict(kind="ALERT", raw_ref_id="A1", severity="CRITICAL", asset_id="S1", event_timestamp=at(10)),
        dict(kind="CASE", raw_ref_id="C1", status="CLOSED", event_timestamp=at(80)),
    )
    out = str(tmp_path / "run")
    for _ in range(2):
        run = analyze(events, entities, PERIOD)
        persist_run(run, out)
    stored = {name: read_table(spark, out, name, "entity_id string") for name in (*FINDINGS, SCORES)}
    assert stored["execution_gaps"].count() == run.gaps.count() == 3
    assert stored[SCORES].count() == 2  # a time series, one row per run
    score = run.scores.first()
    assert score.composite_risk_score > 0 and score.rationale_summary.startswith("Composite Risk Score")
    assert run.cards.count() == run.gaps.count() + run.absences.count()
