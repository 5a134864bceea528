from datetime import datetime, timedelta

from helpers import PERIOD, at

from vigil.operators import execution_gaps as eg
from vigil.operators.conditions import where
from vigil.operators.rules import Rule, check_registry, rule_registry
from vigil.operators.temporal import TemporalJoin, temporal_join

R = rule_registry()


def found(df):
    return df.collect()


def test_uninvestigated_alert(make_events):
    alert = dict(kind="ALERT", raw_ref_id="A1", severity="CRITICAL", event_timestamp=at(3))
    seen = dict(kind="INVESTIGATION", raw_ref_id="I1", alert_id="A1", event_timestamp=at(2.5))
    late = dict(seen, event_timestamp=at(0.9))
    early = dict(seen, event_timestamp=at(3.1))
    untimed = dict(seen, event_timestamp=None)
    rule = R.get("EG-01")
    assert found(eg.uninvestigated_alerts(make_events(alert, seen), rule, PERIOD)) == []
    assert found(eg.uninvestigated_alerts(make_events(alert, untimed), rule, PERIOD)) == []
    for other in (late, early):
        (row,) = found(eg.uninvestigated_alerts(make_events(alert, other), rule, PERIOD))
        assert (row.severity_score, row.severity, row.metric_values["delay_hours"]) == (85, "CRITICAL", "3.0")
    (row,) = found(eg.uninvestigated_alerts(make_events(dict(alert, event_timestamp=None)), rule, PERIOD))
    assert row.severity_score == 80


def test_interval_edges_are_inclusive(make_events):
    alert = dict(kind="ALERT", raw_ref_id="A1", severity="HIGH", event_timestamp=at(10))
    for seconds, n in ((0, 0), (7200, 0), (7200.000001, 1), (-0.000001, 1)):
        inv = dict(kind="INVESTIGATION", case_id="A1", event_timestamp=at(10) + timedelta(seconds=seconds))
        assert eg.uninvestigated_alerts(make_events(alert, inv), R.get("EG-01"), PERIOD).count() == n, seconds


def test_escalation_breaches(make_events):
    case = dict(kind="CASE", raw_ref_id="C1", priority="P1_CRITICAL", event_timestamp=at(10))
    rule = R.get("EG-02")
    (row,) = found(eg.escalation_breaches(make_events(case), rule, PERIOD))
    assert "unescalated after 10.0 hours" in row.rationale
    in_time = dict(kind="ESCALATION", case_id="C1", event_timestamp=at(9))
    assert found(eg.escalation_breaches(make_events(case, in_time), rule, PERIOD)) == []
    late = dict(kind="ESCALATION", case_id="C1", event_timestamp=at(4))
    (row,) = found(eg.escalation_breaches(make_events(case, in_time, late), rule, PERIOD))
    assert row.metric_values["duration_open_hours"] == "6.0" and len(row.evidence_record_ids) == 2
    stated = dict(in_time, escalation_delay_minutes=600.0)
    assert found(eg.escalation_breaches(make_events(case, stated), rule, PERIOD))[0].metric_values["duration_open_hours"] == "10.0"
    breached = dict(in_time, escalation_status="breached")
    assert len(found(eg.escalation_breaches(make_events(case, breached), rule, PERIOD))) == 1
    assert found(eg.escalation_breaches(make_events(dict(case, priority="P2")), rule, PERIOD)) == []


def test_stale_cases(make_events):
    case = dict(kind="CASE", raw_ref_id="C1", status="open", event_timestamp=at(100))
    rule = R.get("EG-03")
    (row,) = found(eg.stale_cases(make_events(case), rule, PERIOD))
    assert (row.severity_score, row.severity) == (55, "MEDIUM")
    touched = dict(kind="ACTIVITY", case_id="C1", event_timestamp=at(70))
    assert found(eg.stale_cases(make_events(case, touched), rule, PERIOD)) == []
    assert found(eg.stale_cases(make_events(dict(case, event_timestamp=at(72))), rule, PERIOD)) == []
    assert len(found(eg.stale_cases(make_events(dict(case, event_timestamp=at(1), resolution_time_hours=80.0)), rule, PERIOD))) == 1


def test_closed_without_notes(make_events):
    case = dict(kind="CASE", raw_ref_id="C1", status="CLOSED", event_timestamp=at(5))
    rule = R.get("EG-04")

    def run(*inv, **extra):
        return found(eg.closed_without_notes(make_events(dict(case, **extra), *inv), rule, PERIOD))

    note = dict(kind="INVESTIGATION", case_id="C1", event_timestamp=at(6))
    assert "[NO NOTES RECORDED]" in run()[0].rationale
    assert run(notes="Contained the host and reset credentials") == []
    assert '("done")' in run(notes="done")[0].rationale
    rows = run(dict(note, investigation_notes="short"), dict(note, conclusion="one"))
    assert rows[0].metric_values["notes_length"] == "9" and rows[0].evidence_count == 3
    assert run(dict(note, investigation_notes="ten chars."), dict(note, investigation_notes="ten chars.")) == []
    many = [dict(note) for _ in range(30)]
    (row,) = run(*many)
    assert row.evidence_count == 31 and len(set(row.evidence_record_ids)) == 31
    # blanks count within the joined text, however long they are
    assert run(dict(note, investigation_notes="x"), dict(note, investigation_notes=" " * 60 + "y")) == []
    assert len(run(dict(note, investigation_notes="x"), dict(note, investigation_notes="y" + " " * 60))) == 1
    events = make_events(case, *many)
    assert eg.closure_evidence(events, eg.closed_without_notes(events, rule, PERIOD)).count() == 31


def test_unowned_assets(make_events):
    alert = dict(kind="ALERT", raw_ref_id="A1", asset_id="srv-1", event_timestamp=at(1))
    asset = dict(kind="ASSET", asset_id="X1", hostname="srv-1", criticality_tier="crown_jewel", owner="ops")
    rule = R.get("EG-05")
    (row,) = found(eg.unowned_assets(make_events(alert, asset), rule, PERIOD))
    assert row.metric_values["department"] == "UNASSIGNED" and row.raw_evidence_refs == ["srv-1", "A1"]
    assert found(eg.unowned_assets(make_events(alert, dict(asset, department="it")), rule, PERIOD)) == []
    newer = dict(asset, asset_id="srv-1", department="it")  # the later row answers to the same name
    assert found(eg.unowned_assets(make_events(alert, asset, newer), rule, PERIOD)) == []
    assert len(found(eg.unowned_assets(make_events(dict(alert, event_id=None, criticality_tier="TIER_1")), rule, PERIOD))) == 1


def test_escalation_without_incident(make_events):
    esc = dict(kind="ESCALATION", raw_ref_id="S1", case_id="C1", escalated_to="SOC DIRECTOR", event_timestamp=at(50))
    incident = dict(kind="INCIDENT", case_id="C1", event_timestamp=at(30))
    rule = R.get("EG-06")
    assert found(eg.escalations_without_incident(make_events(esc, incident), rule, PERIOD)) == []
    assert len(found(eg.escalations_without_incident(make_events(esc, dict(incident, event_timestamp=at(25))), rule, PERIOD))) == 1
    assert found(eg.escalations_without_incident(make_events(dict(esc, escalated_to="TIER_2")), rule, PERIOD)) == []


def test_rapid_closures(make_events):
    def closing(n, gap, start=at(20), who="an1"):
        return [
            dict(kind="CASE", raw_ref_id=f"C{who}{i}", status="RESOLVED", user_id=who, event_timestamp=start,
                 closed_at=start + timedelta(seconds=gap * i))
            for i in range(n)
        ]

    rule = R.get("EG-07")
    assert found(eg.rapid_closures(make_events(*closing(9, 1)), rule, PERIOD)) == []
    (row,) = found(eg.rapid_closures(make_events(*closing(12, 13)), rule, PERIOD))
    assert row.metric_values["elapsed_seconds"] == "117" and row.raw_evidence_refs == [f"Can1{i}" for i in range(10)]
    assert found(eg.rapid_closures(make_events(*closing(12, 14)), rule, PERIOD)) == []
    # many closures at one instant, and a run that crosses a slice border
    same = closing(40, 0) + closing(10, 13, start=datetime(2026, 8, 20, 0, 1, 0), who="an2")
    rows = found(eg.rapid_closures(make_events(*same), rule, PERIOD))
    assert sorted(r.metric_values["elapsed_seconds"] for r in rows) == ["0", "117"]


def test_off_hours_delay(make_events):
    night = datetime(2026, 8, 25, 2, 0)
    alert = dict(kind="ALERT", raw_ref_id="A1", severity="HIGH", event_timestamp=night)
    rule = R.get("EG-08")
    assert found(eg.off_hours_delays(make_events(alert), rule, PERIOD))[0].metric_values["delay_minutes"] == "600"
    acted = dict(kind="ACTIVITY", alert_id="A1", event_timestamp=night + timedelta(minutes=61))
    assert found(eg.off_hours_delays(make_events(alert, acted), rule, PERIOD))[0].metric_values["delay_minutes"] == "61"
    earlier = dict(acted, event_timestamp=night - timedelta(hours=5))
    assert found(eg.off_hours_delays(make_events(alert, acted, earlier), rule, PERIOD)) == []
    assert found(eg.off_hours_delays(make_events(dict(alert, event_timestamp=datetime(2026, 8, 25, 8, 0))), rule, PERIOD)) == []


def test_declarative_rule_and_registry(make_events):
    rule = Rule(
        "EG-99", "No activity", "alert_metadata", 60, 0.5, condition=where("severity", "EQ", "high"),
        join=TemporalJoin("analyst_activity", "case_id", "alert_id", "NOT_EXISTS", 3600),
        description="{rule_code} {ref_id}", rationale="{name} {entity_id}",
    )
    alert = dict(kind="ALERT", raw_ref_id="A1", case_id="C1", severity="HIGH", event_timestamp=at(5))
    events = make_events(alert, dict(kind="ACTIVITY", alert_id="C1", event_timestamp=at(3)))
    (row,) = found(eg.declarative_rule(events, rule, PERIOD))
    assert (row.description, row.rationale, row.severity) == ("EG-99 A1", "No activity B", "MEDIUM")
    near = make_events(alert, dict(kind="ACTIVITY", alert_id="C1", event_timestamp=at(5.9)))
    assert found(eg.declarative_rule(near, rule, PERIOD)) == []
    registry = rule_registry()
    for code in list(registry.entries):
        registry.enable(code, False)
    registry.register(rule)
    assert [r.rule_id for r in found(eg.evaluate_rules(events, PERIOD, registry))] == ["EG-99"]
    checks = check_registry()
    try:
        checks.register(R.get("EG-01"))
        raise AssertionError("unknown checks must be refused")
    except ValueError:
        pass


def test_joins_stay_equi_joins(make_events):
    alert = dict(kind="ALERT", raw_ref_id="A1", severity="HIGH", event_timestamp=at(5))
    events = make_events(alert, dict(kind="INVESTIGATION", alert_id="A1", event_timestamp=at(4)))
    plans = [
        eg.uninvestigated_alerts(events, R.get("EG-01"), PERIOD),
        temporal_join(events, TemporalJoin("investigation_records", max_seconds=60), events),
        eg.escalations_without_incident(events, R.get("EG-06"), PERIOD),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_minimum_time_distance(make_events):
    case = dict(kind="CASE", raw_ref_id="C1", event_timestamp=at(10))

    def matches(hours):
        events = make_events(case, dict(kind="ACTIVITY", raw_ref_id="C1", event_timestamp=at(hours)))
        cases = events.where("dataset_type = 'case_management'")
        join = TemporalJoin("analyst_activity", relation="EXISTS", max_seconds=4 * 3600, min_seconds=2 * 3600)
        return temporal_join(cases, join, events).count()

    assert [matches(h) for h in (5.9, 6, 7, 8, 8.1, 10, 11.9, 12, 13, 14, 14.1)] == [0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 0]


def test_reruns_give_the_same_ids(make_events):
    events = make_events(dict(kind="ALERT", raw_ref_id="A1", severity="HIGH", event_timestamp=at(5)))
    a, b = (eg.uninvestigated_alerts(events, R.get("EG-01"), PERIOD).first().finding_id for _ in range(2))
    assert a == b and len(a) == 36
