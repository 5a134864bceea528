import math
import random
from datetime import datetime, timedelta

from helpers import NOW, PERIOD, at
from pyspark.sql import functions as F

from vigil.functions.stats import ewma, sample_weight
from vigil.operators import absence as ns
from vigil.operators.rules import check_registry

C = check_registry()


def python_ewma(series, alpha):
    if not series:
        return 0.0, 0.0
    mean, variance = series[0], 0.0
    for x in series[1:]:
        mean = alpha * x + (1 - alpha) * mean
        variance = alpha * (x - mean) ** 2 + (1 - alpha) * variance
    return mean, math.sqrt(variance)


def test_ewma_fold(spark):
    rng = random.Random(3)
    series = [[100.0, 105.0, 98.0], [], [5.0], [10.0] * 8, [1.0, 1e9]] + [
        [rng.uniform(0, 50) for _ in range(rng.randint(2, 20))] for _ in range(10)
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, s array<double>")
    for alpha in (0.0, 0.2, 1.0):
        for row in df.select("i", ewma(F.col("s"), alpha).alias("e")).collect():
            want = python_ewma(series[row.i], alpha)
            assert math.isclose(row.e.mu, want[0], rel_tol=1e-9) and math.isclose(row.e.sigma, want[1], rel_tol=1e-9, abs_tol=1e-9)


def daily(volumes, start=datetime(2026, 8, 3)):
    return [
        dict(kind="ALERT", event_timestamp=start + timedelta(days=d, seconds=i))
        for d, n in enumerate(volumes) for i in range(n)
    ]


def test_volume_cliff(make_events):
    (row,) = ns.volume_cliffs(make_events(*daily([20, 21, 20, 19, 20, 1]))).collect()
    assert row.is_finding and row.history_days == 5 and row.observed_volume == 1.0
    assert not ns.volume_cliffs(make_events(*daily([20, 30, 10, 24, 16, 19]))).first().is_finding
    assert ns.volume_cliffs(make_events(*daily([20, 20, 20, 1]))).count() == 0
    (finding,) = ns.volume_cliff_findings(make_events(*daily([20, 21, 20, 19, 20, 1])), C.get("NS-01"), PERIOD).collect()
    assert finding.severity_score == 85 and len(finding.evidence_record_ids) == 1 and not finding.is_degraded
    (weak,) = ns.volume_cliff_findings(make_events(*daily([2, 2, 2, 2, 2, 1])), C.get("NS-01"), PERIOD, k=0.5).collect()
    assert weak.is_degraded and weak.degradation_factor == round(11 / 15, 4) and "LOW SAMPLE" in weak.rationale


def test_zero_fill_shows_silent_days(make_events):
    events = make_events(*daily([3, 0, 3]))
    assert ns.daily_volume(events).count() == 2
    assert sorted(r.volume for r in ns.daily_volume(events, zero_fill=True).collect()) == [0, 3, 3]


def test_entropy(make_events):
    def run(labels):
        return ns.category_entropy(make_events(*[dict(kind="ALERT", rule_id=x) for x in labels]), "rule_id").first()

    assert (run("A" * 50).entropy, run("A" * 50).max_entropy) == (0.0, 0.0)
    assert run("ABCD" * 25).entropy == 2.0
    mixed = run("A" * 99 + "B")
    assert 0 < mixed.entropy < 0.1 and mixed.categories == 2


def python_cv(times):
    times = sorted(times)
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    var = sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1) if len(gaps) > 1 else 0.0
    return (0.0 if mean <= 0 else math.sqrt(var) / mean), mean


def test_inter_arrival_matches_a_plain_loop(make_events):
    rng = random.Random(5)
    rows, want = [], {}
    for e in range(12):
        n = rng.randint(2, 60)
        times = [datetime(2026, 8, 1) + timedelta(microseconds=rng.randrange(0, 10**rng.randint(3, 12))) for _ in range(n)]
        times += times[: n // 3]  # copies
        want[f"E{e}"] = python_cv(times)
        rows += [dict(kind="ALERT", entity_id=f"E{e}", event_timestamp=t) for t in times]
    rows += [dict(kind="ALERT", entity_id="beat", event_timestamp=NOW + timedelta(seconds=60 * i)) for i in range(30)]
    rows += [dict(kind="ALERT", entity_id="one", event_timestamp=NOW)]
    got = {r.entity_id: r for r in ns.inter_arrival(make_events(*rows)).collect()}
    for e, (cv, mean) in want.items():
        assert abs(got[e].cv - cv) < 1.1e-5 and abs(got[e].mean_seconds - mean) < 0.011
    assert (got["beat"].cv, got["beat"].mean_seconds) == (0.0, 60.0)
    assert (got["one"].cv, got["one"].samples) == (1.0, 1)


def test_sample_weight(spark):
    rows = spark.createDataFrame([(0,), (7,), (15,), (1000,)], "n int").select(sample_weight("n", 15).alias("w")).collect()
    assert [r.w for r in rows] == [0.1, 0.4667, 1.0, 1.0]


def test_counting_checks(make_events):
    saturday = datetime(2026, 8, 22, 10)
    weekend = [dict(kind="ALERT", severity="HIGH", event_timestamp=saturday + timedelta(minutes=i)) for i in range(20)]
    assert ns.weekend_silence(make_events(*weekend), C.get("NS-02"), PERIOD).first().severity_score == 80
    assert ns.weekend_silence(make_events(*weekend[1:]), C.get("NS-02"), PERIOD).count() == 0
    active = weekend + [dict(kind="ACTIVITY", event_timestamp=saturday)]
    assert ns.weekend_silence(make_events(*active), C.get("NS-02"), PERIOD).count() == 0
    (row,) = ns.surge_without_escalation(make_events(*weekend), C.get("NS-05"), PERIOD).collect()
    assert row.expected_volume == 20.0 and len(row.evidence_record_ids) == 20 and row.severity == "CRITICAL"
    cases = [dict(kind="CASE", status="CLOSED" if i < 2 else "OPEN", event_timestamp=at(i)) for i in range(30)]
    (row,) = ns.closure_deficit(make_events(*cases), C.get("NS-04"), PERIOD).collect()
    assert row.drop_percentage == 93.3 and "closure rate 6.7% < 10% threshold" in row.rationale
    beat = [dict(kind="ALERT", rule_id="R", event_timestamp=NOW + timedelta(seconds=60 * i)) for i in range(50)]
    assert ns.synthetic_heartbeat(make_events(*beat), C.get("NS-07"), PERIOD).count() == 1
    assert ns.rule_monoculture(make_events(*beat), C.get("NS-06"), PERIOD).first().drop_percentage == 100.0


def test_jewels_and_incidents(make_events):
    rows = [
        dict(kind="ASSET", asset_id="J1", hostname="h1", criticality_tier="Tier-1"),
        dict(kind="ASSET", asset_id="J2", hostname="h2", criticality_tier="CROWN_JEWEL"),
        dict(kind="ASSET", asset_id="J3", criticality_tier="CRITICAL"),
        dict(kind="ASSET", asset_id="L1", criticality_tier="LOW"),
        dict(kind="COVERAGE", asset_id="h1", event_timestamp=at(1)),
        dict(kind="ALERT", asset_id="J3", event_timestamp=at(1)),
    ]
    (row,) = ns.uncovered_jewels(make_events(*rows), C.get("NS-03"), PERIOD).collect()
    assert (row.expected_volume, row.observed_volume, row.drop_percentage) == (3.0, 2.0, 33.3)
    assert row.raw_evidence_refs == ["J2"] and "1 out of 3" in row.rationale
    many = [dict(kind="ASSET", asset_id=f"M{i}", criticality_tier="CRITICAL") for i in range(25)]
    (row,) = ns.uncovered_jewels(make_events(*many), C.get("NS-03"), PERIOD).collect()
    assert len(row.evidence_record_ids) == len(row.raw_evidence_refs) == row.evidence_count == 25
    incident = dict(kind="INCIDENT", raw_ref_id="X", resolved_at=NOW - timedelta(days=15), event_timestamp=NOW - timedelta(days=20))
    check = C.get("NS-08")
    assert ns.untraced_incidents(make_events(incident), check, PERIOD).first().severity == "MEDIUM"
    before = dict(kind="ACTIVITY", event_timestamp=NOW - timedelta(days=16))
    assert ns.untraced_incidents(make_events(incident, before), check, PERIOD).count() == 1
    assert ns.untraced_incidents(make_events(incident, dict(before, event_timestamp=at(24))), check, PERIOD).count() == 0
    recent = dict(incident, resolved_at=NOW - timedelta(days=14))
    assert ns.untraced_incidents(make_events(recent), check, PERIOD).count() == 0


def test_evidence_is_chosen_among_rows_of_findings(make_events, monkeypatch):
    """Rows of entities, and days, without a finding are neither moved nor sorted; a shuffle join beyond the limit gives the same."""
    fallen = [dict(r, entity_id="fallen") for r in daily([20, 21, 20, 19, 20, 1])]
    steady = [dict(r, entity_id="steady") for r in daily([20, 30, 10, 24, 16, 19])]
    events, ranked, plain = make_events(*fallen, *steady), [], ns.leading_evidence
    monkeypatch.setattr(ns, "leading_evidence", lambda rows: ranked.append(rows.count()) or plain(rows))
    (one,) = ns.volume_cliff_findings(events, C.get("NS-01"), PERIOD).collect()
    hits = ns.entity_counters(events).where("entity_id = 'fallen'")
    (two,) = ns._with_evidence(hits, events).collect()
    assert ranked == [1, len(fallen)] and one.entity_id == two.entity_id == "fallen" and len(two.evidence) == ns.EVIDENCE_LIMIT
    monkeypatch.setattr(ns, "BROADCAST_ENTITIES", 0)
    assert ns.volume_cliff_findings(events, C.get("NS-01"), PERIOD).collect() == [one]
    assert ns._with_evidence(hits, events).collect() == [two]
