"""Queries for process-gap rules, temporal joins and condition operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.catalog.families import (
    EVENTS_PERIOD,
    ORDERS_PERIOD,
    alerts,
    activity,
    asset_alerts,
    assets,
    case_escalations,
    case_followups,
    case_notes,
    cases,
    entities,
    escalations,
    incidents,
    investigations,
    purchases_as_closures,
    telemetry,
    with_sql,
)
from vigil.catalog.registry import query
from vigil.functions.timestamps import is_night, is_weekend
from vigil.operators import execution_gaps as eg
from vigil.operators.conditions import Condition, all_of, any_of, compile_condition, listing_filter, none_of, where
from vigil.operators.absence import closure_deficit
from vigil.operators.rules import Rule, check_registry, rule_registry
from vigil.operators.temporal import TemporalJoin, temporal_join
from vigil.operators.views import grouped_findings, search_findings, unified_findings

RULES = rule_registry()
EVENTS_END = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_END = "TIMESTAMP '2001-12-01 00:00:00'"


def gap_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        "entity_id", "rule_id", F.col("evidence_record_ids")[0].alias("subject"), "severity",
        F.col("severity_score").cast("bigint").alias("severity_score"), "evidence_count", "description", "rationale",
    )


TIER = "CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"
COLUMNS = "entity_id, rule_id, subject, severity, CAST(score AS BIGINT) AS severity_score, CAST(n_evidence AS BIGINT) AS evidence_count, description, rationale"

# each fragment yields entity_id, rule_id, subject, severity, score, n_evidence, description, rationale
EG01 = f"""eg01 AS (
  SELECT entity_id, 'EG-01' AS rule_id, event_id AS subject, {TIER} AS severity, score, 1 AS n_evidence,
    'Critical or High severity alert ' || ref || ' (error) uninvestigated after 2-hour SLA.' AS description,
    'Alert ' || ref || ' (error) on asset ' || asset_id || ' with severity ' || severity || ' received no investigation within the 2-hour SLA window.' AS rationale
  FROM (SELECT a.* , least(100, 70 + 5 * floor(greatest(2.0, (epoch_us({EVENTS_END}) - epoch_us(a.ts)) / 3600e6))) AS score
    FROM alerts a WHERE severity IN ('CRITICAL', 'HIGH') AND NOT EXISTS (
      SELECT 1 FROM inv i WHERE i.entity_id = a.entity_id AND (i.case_id = a.case_id OR i.alert_id = a.ref)
        AND i.ts >= a.ts AND i.ts <= a.ts + INTERVAL 2 HOUR)))"""
EG02 = f"""esc2 AS (SELECT * REPLACE (CASE WHEN l_returnflag <> 'N' THEN case_id END AS case_id),
    CASE WHEN l_returnflag <> 'R' THEN l_quantity WHEN l_linestatus = 'F' THEN l_quantity * 10 END AS minutes,
    CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 THEN 'BREACHED' ELSE 'DONE' END AS state FROM lines),
judged AS (SELECT c.event_id AS case_event, e.*, coalesce(e.minutes / 60.0, greatest(0.0, (epoch_us(e.ts) - epoch_us(c.ts)) / 3600e6)) AS delay
  FROM cases c JOIN esc2 e ON c.entity_id = e.entity_id AND c.case_id = e.case_id WHERE c.priority = 'P1_CRITICAL'),
firsts AS (SELECT case_event, max(CASE WHEN delay > 4 OR state = 'BREACHED' THEN 1 ELSE 0 END) AS breached,
    arg_min(delay, (ts, n, event_id)) FILTER (WHERE delay > 4 OR state = 'BREACHED') AS delay,
    arg_min(state, (ts, n, event_id)) FILTER (WHERE delay > 4 OR state = 'BREACHED') AS state
  FROM judged GROUP BY case_event),
eg02 AS (
  SELECT entity_id, 'EG-02' AS rule_id, c.event_id AS subject, 'CRITICAL' AS severity, 85 AS score,
    CASE WHEN f.breached = 1 THEN 2 ELSE 1 END AS n_evidence,
    CASE WHEN f.breached = 1 THEN 'P1 Critical Case ' || case_id || ' escalation was delayed (' || format('{{:.1f}}', round(f.delay, 1)) || 'h) beyond 4-hour SLA.'
      ELSE 'P1 Critical Case ' || case_id || ' remained unescalated beyond 4-hour SLA.' END AS description,
    CASE WHEN f.breached = 1 THEN 'P1 Critical Case ' || case_id || ' had a delayed escalation exceeding the 4-hour SLA (escalation delay: '
        || format('{{:.1f}}', round(f.delay, 1)) || ' hours, status: ' || f.state || ').'
      ELSE 'P1 Critical Case ' || case_id || ' remained unescalated after ' || format('{{:.1f}}', open_hours) || ' hours of active status.' END AS rationale
  FROM (SELECT *, greatest(0.0, (epoch_us({ORDERS_END}) - epoch_us(ts)) / 3600e6) AS open_hours FROM cases WHERE priority = 'P1_CRITICAL') c
  LEFT JOIN firsts f ON f.case_event = c.event_id
  WHERE f.breached = 1 OR (f.breached IS NULL AND open_hours >= 4))"""
EG03 = f"""last_action AS (SELECT entity_id, case_id, max(ts) AS t FROM lines GROUP BY 1, 2),
eg03 AS (
  SELECT entity_id, 'EG-03' AS rule_id, event_id AS subject, {TIER} AS severity, score, 1 AS n_evidence,
    'Case ' || case_id || ' has been dormant/unassigned for over 72 hours without analyst activity.' AS description,
    'Case ' || case_id || ' has been dormant/unassigned for ' || format('{{:.1f}}', round(idle / 24.0, 1)) || ' days without any analyst audit trail or notes.' AS rationale
  FROM (SELECT *, least(100, 50 + 5 * floor((idle - 72) / 24)) AS score FROM (
    SELECT c.*, greatest(0.0, (epoch_us({ORDERS_END}) - epoch_us(coalesce(l.t, c.ts))) / 3600e6) AS idle
    FROM cases c LEFT JOIN last_action l USING (entity_id, case_id) WHERE status IN ('OPEN', 'IN_PROGRESS')) WHERE idle > 72))"""
EG04 = """case_text AS (SELECT entity_id, case_id, count(*) AS n_inv,
    string_agg(CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'reviewed ' || l_linestatus END, ' ' ORDER BY ts, n, event_id) AS text
  FROM lines GROUP BY 1, 2),
eg04 AS (
  SELECT entity_id, 'EG-04' AS rule_id, event_id AS subject, 'HIGH' AS severity, 75 AS score, 1 + coalesce(n_inv, 0) AS n_evidence,
    'Case ' || case_id || ' closed without adequate resolution notes.' AS description,
    'Case ' || case_id || ' was closed with non-diligent resolution notes ("' || coalesce(text, '[NO NOTES RECORDED]') || '").' AS rationale
  FROM cases LEFT JOIN case_text USING (entity_id, case_id)
  WHERE status = 'CLOSED' AND (text IS NULL OR length(text) < 20))"""
EG05 = """directory AS (SELECT entity_id, asset_id AS k, tier, owner, department, hostname FROM assets
  UNION ALL SELECT entity_id, hostname, tier, owner, department, hostname FROM assets),
eg05 AS (
  SELECT a.entity_id, 'EG-05' AS rule_id, a.event_id AS subject, 'MEDIUM' AS severity, 65 AS score, 2 AS n_evidence,
    'Alert on Crown Jewel asset ' || a.asset_id || ' lacking CMDB ownership.' AS description,
    'Crown Jewel asset ' || d.hostname || ' (' || a.asset_id || ') triggered critical security alerts but lacks an assigned departmental owner in CMDB.' AS rationale
  FROM asset_alerts a JOIN directory d ON a.entity_id = d.entity_id AND a.asset_id = d.k
  WHERE d.tier IN ('CROWN_JEWEL', 'CRITICAL', 'TIER_1') AND (d.owner IS NULL OR d.department IS NULL))"""
EG06 = """eg06 AS (
  SELECT entity_id, 'EG-06' AS rule_id, event_id AS subject, 'HIGH' AS severity, 80 AS score, 1 AS n_evidence,
    'Tier-3 IR escalation for Case ' || case_id || ' missing incident declaration report.' AS description,
    'Tier-3 IR escalation for Case ' || case_id || ' was not followed by a formal incident declaration report within 24 hours.' AS rationale
  FROM esc e WHERE escalated_to <> 'TIER_2_DESK' AND NOT EXISTS (
    SELECT 1 FROM inc i WHERE i.entity_id = e.entity_id AND i.case_id = e.case_id AND i.ts >= e.ts AND i.ts <= e.ts + INTERVAL 24 HOUR))"""
EG08 = f"""first_action AS (SELECT entity_id, alert_id AS ref, min(ts) AS t FROM (
    SELECT entity_id, alert_id, ts FROM inv UNION ALL SELECT entity_id, alert_id, ts FROM act) GROUP BY 1, 2),
eg08 AS (
  SELECT entity_id, 'EG-08' AS rule_id, event_id AS subject, 'HIGH' AS severity, 85 AS score, 1 AS n_evidence,
    'Off-hours critical alert ' || ref || ' triage delay breached 60-minute SLA.' AS description,
    'Off-hours critical alert ' || ref || ' experienced triage delay of ' || CAST(floor(minutes) AS BIGINT) || ' minutes, breaching the 60-minute off-hours SLA.' AS rationale
  FROM (SELECT a.*, CASE WHEN f.t IS NOT NULL THEN greatest(0.0, (epoch_us(f.t) - epoch_us(a.ts)) / 60e6)
      ELSE greatest(60.0, (epoch_us({EVENTS_END}) - epoch_us(a.ts)) / 60e6) END AS minutes
    FROM alerts a LEFT JOIN first_action f USING (entity_id, ref)
    WHERE severity IN ('CRITICAL', 'HIGH') AND (isodow(ts) >= 6 OR hour(ts) < 8 OR hour(ts) >= 18)) WHERE minutes > 60)"""
CLOSURE_SECONDS = 259200
EG07 = f"""closed AS (SELECT entity_id, event_id, n, ts, lead(ts, 9) OVER w AS t_last,
    list(event_id) OVER (PARTITION BY entity_id ORDER BY ts, n, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run
  FROM inc WINDOW w AS (PARTITION BY entity_id ORDER BY ts, n, event_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, n, event_id) AS r FROM closed
  WHERE epoch_us(t_last) - epoch_us(ts) <= CAST({CLOSURE_SECONDS} AS BIGINT) * 1000000),
eg07 AS (
  SELECT entity_id, 'EG-07' AS rule_id, event_id AS subject, 'CRITICAL' AS severity, 90 AS score, 10 AS n_evidence,
    'Analyst N' || entity_id || ' dismissed 10 cases in ' || ((epoch_us(t_last) - epoch_us(ts)) // 1000000) || ' seconds.' AS description,
    'Analyst N' || entity_id || ' dismissed 10 cases in ' || ((epoch_us(t_last) - epoch_us(ts)) // 1000000) || ' seconds, indicating systematic rubber-stamping.' AS rationale
  FROM hits WHERE r = 1)"""


@query("eg01_uninvestigated_alerts", with_sql("alerts", "inv", extra=EG01, body=f"SELECT {COLUMNS} FROM eg01"))
def eg01(spark, sf):
    events = alerts(spark, sf).unionByName(investigations(spark, sf))
    return gap_rows(eg.uninvestigated_alerts(events, RULES.get("EG-01"), EVENTS_PERIOD))


@query("eg02_escalation_breaches", with_sql("cases", "lines", extra=EG02, body=f"SELECT {COLUMNS} FROM eg02"))
def eg02(spark, sf):
    events = cases(spark, sf).unionByName(case_escalations(spark, sf))
    return gap_rows(eg.escalation_breaches(events, RULES.get("EG-02"), ORDERS_PERIOD))


@query("eg03_stale_cases", with_sql("cases", "lines", extra=EG03, body=f"SELECT {COLUMNS} FROM eg03"))
def eg03(spark, sf):
    events = cases(spark, sf).unionByName(case_followups(spark, sf))
    return gap_rows(eg.stale_cases(events, RULES.get("EG-03"), ORDERS_PERIOD))


@query("eg04_closed_without_notes", with_sql("cases", "lines", extra=EG04, body=f"SELECT {COLUMNS} FROM eg04"))
def eg04(spark, sf):
    events = cases(spark, sf).unionByName(case_notes(spark, sf))
    return gap_rows(eg.closed_without_notes(events, RULES.get("EG-04"), ORDERS_PERIOD))


@query(
    "eg04_complete_evidence",
    with_sql("cases", "lines", extra=EG04, body="""
SELECT entity_id, subject AS case_event, subject AS event_id FROM eg04
UNION ALL SELECT e.entity_id, e.subject, l.event_id FROM eg04 e JOIN lines l
  ON l.entity_id = e.entity_id AND 'O' || l.case_id[2:] = e.subject"""),
)
def eg04_evidence(spark, sf):
    events = cases(spark, sf).unionByName(case_notes(spark, sf))
    found = eg.closed_without_notes(events, RULES.get("EG-04"), ORDERS_PERIOD)
    names = found.select("finding_id", F.col("evidence_record_ids")[0].alias("case_event"))
    return eg.closure_evidence(events, found).join(names, "finding_id").select("entity_id", "case_event", "event_id")


@query("eg05_unowned_assets", with_sql("assets", "asset_alerts", extra=EG05, body=f"SELECT {COLUMNS} FROM eg05"))
def eg05(spark, sf):
    events = assets(spark, sf).unionByName(asset_alerts(spark, sf))
    return gap_rows(eg.unowned_assets(events, RULES.get("EG-05"), ORDERS_PERIOD))


@query("eg06_escalations_without_incident", with_sql("esc", "inc", extra=EG06, body=f"SELECT {COLUMNS} FROM eg06"))
def eg06(spark, sf):
    events = escalations(spark, sf).unionByName(incidents(spark, sf))
    return gap_rows(eg.escalations_without_incident(events, RULES.get("EG-06"), EVENTS_PERIOD))


@query("eg07_rapid_closures", with_sql("inc", extra=EG07, body=f"SELECT {COLUMNS}, array_to_string(run, ',') AS batch FROM (SELECT e.*, h.run FROM eg07 e JOIN hits h ON h.event_id = e.subject AND h.r = 1)"))
def eg07(spark, sf):
    found = eg.rapid_closures(
        purchases_as_closures(spark, sf), RULES.get("EG-07"), EVENTS_PERIOD, window_seconds=CLOSURE_SECONDS
    )
    batches = found.select("entity_id", F.array_join("evidence_record_ids", ",").alias("batch"))
    return gap_rows(found).join(batches, "entity_id")


@query("eg08_off_hours_delays", with_sql("alerts", "inv", "act", extra=EG08, body=f"SELECT {COLUMNS} FROM eg08"))
def eg08(spark, sf):
    events = alerts(spark, sf).unionByName(investigations(spark, sf)).unionByName(activity(spark, sf))
    return gap_rows(eg.off_hours_delays(events, RULES.get("EG-08"), EVENTS_PERIOD))


CUSTOM = Rule(
    code="EG-90", name="Severe alert without activity", target_dataset="alert_metadata", severity_base=72,
    condition=all_of(where("severity", "IN", ["critical", "high"]), none_of(where("rule_id", "EQ", "r1"))),
    join=TemporalJoin("analyst_activity", join_key="case_id", relation="NOT_EXISTS", max_seconds=86400),
    description="{rule_code}: {ref_id}", rationale="{name} at entity {entity_id}",
)
EGG = """egg AS (SELECT entity_id, 'EG-90' AS rule_id, event_id AS subject, 'HIGH' AS severity, 72 AS score, 1 AS n_evidence,
    'EG-90: ' || ref AS description, 'Severe alert without activity at entity ' || entity_id AS rationale
  FROM alerts a WHERE severity IN ('CRITICAL', 'HIGH') AND rule_id <> 'R1' AND NOT EXISTS (
    SELECT 1 FROM act t WHERE t.entity_id = a.entity_id AND t.case_id = a.case_id
      AND abs(epoch_us(t.ts) - epoch_us(a.ts)) <= 86400000000))"""


@query("egg_declarative_rule", with_sql("alerts", "act", extra=EGG, body=f"SELECT {COLUMNS} FROM egg"))
def egg(spark, sf):
    events = alerts(spark, sf).unionByName(activity(spark, sf))
    return gap_rows(eg.declarative_rule(events, CUSTOM, EVENTS_PERIOD))


EVENT_RULES = ("EG-01", "EG-06", "EG-08")


@query(
    "rule_registry_run",
    with_sql("alerts", "inv", "act", "esc", "inc", extra=",\n".join((EG01, EG06, EG08, EGG)), body="""
SELECT entity_id, rule_id, count(*) AS findings, CAST(sum(score) AS BIGINT) AS total_score FROM (
  SELECT entity_id, rule_id, score FROM eg01 UNION ALL SELECT entity_id, rule_id, score FROM eg06
  UNION ALL SELECT entity_id, rule_id, score FROM eg08 UNION ALL SELECT entity_id, rule_id, score FROM egg)
GROUP BY entity_id, rule_id"""),
)
def registry_run(spark, sf):
    registry = rule_registry()
    registry.register(CUSTOM)
    found = eg.evaluate_rules(telemetry(spark, sf), EVENTS_PERIOD, registry)
    return found.groupBy("entity_id", "rule_id").agg(
        F.count("*").alias("findings"), F.sum("severity_score").alias("total_score")
    )


# --- temporal joins -------------------------------------------------------------------------------

J1_MATCH = """(i.ref IN (a.ref, a.case_id) OR i.case_id IN (a.ref, a.case_id))
      AND abs(epoch_us(i.ts) - epoch_us(a.ts)) <= 7200000000"""


def _j1(relation: str, negate: str) -> None:
    sql = with_sql("alerts", "inv", body=f"""SELECT entity_id, event_id FROM alerts a WHERE {negate} EXISTS (
  SELECT 1 FROM inv i WHERE i.entity_id = a.entity_id AND {J1_MATCH})""")

    @query(f"j1_temporal_{relation.lower()}", sql)
    def run(spark, sf):
        events = alerts(spark, sf).unionByName(investigations(spark, sf))
        join = TemporalJoin("investigation_records", "raw_ref_id", "case_id", relation, 7200)
        return temporal_join(alerts(spark, sf), join, events).select("entity_id", "event_id")


_j1("EXISTS", "")
_j1("NOT_EXISTS", "NOT")


@query(
    "j1_keys_only",
    with_sql("alerts", "inv", body="""SELECT entity_id, event_id FROM alerts a WHERE EXISTS (
  SELECT 1 FROM inv i WHERE i.entity_id = a.entity_id AND i.alert_id = a.ref AND i.minutes > 20)"""),
)
def j1_keys(spark, sf):
    primary = alerts(spark, sf).withColumn("alert_id", F.col("raw_ref_id"))
    events = primary.unionByName(investigations(spark, sf))
    join = TemporalJoin(
        "investigation_records", "alert_id", relation="EXISTS",
        target_condition=where("time_spent_minutes", "GT", 20),
    )
    return temporal_join(primary, join, events).select("entity_id", "event_id")


# --- condition operators --------------------------------------------------------------------------

OPERATOR_CASES = {
    "f01_eq": (where("severity", "EQ", " critical "), "severity = 'CRITICAL'"),
    "f02_ne": (where("severity", "NE", "low"), "severity <> 'LOW'"),
    "f03_gt": (where("value", "GT", "30"), "value > 30"),
    "f04_gte": (where("value", "GTE", 35), "value >= 35"),
    "f05_lt": (where("value", "LT", 15), "value < 15"),
    "f06_lte": (where("value", "LTE", "14.5"), "value <= 14.5"),
    "f07_in": (where("severity", "IN", ["high", " LOW"]), "severity IN ('HIGH', 'LOW')"),
    "f08_not_in": (where("severity", "NOT_IN", ["high", "low"]), "severity NOT IN ('HIGH', 'LOW')"),
    "f09_contains": (where("rule_id", "CONTAINS", "r1"), "contains(lower(rule_id), 'r1')"),
    "f10_not_contains": (where("rule_id", "NOT_CONTAINS", "7"), "NOT contains(rule_id, '7')"),
    "f11_starts_with": (where("rule_id", "STARTS_WITH", "r2"), "starts_with(lower(rule_id), 'r2')"),
    "f12_ends_with": (where("rule_id", "ENDS_WITH", "3"), "suffix(rule_id, '3')"),
    "f13_regex": (where("rule_id", "REGEX_MATCH", "^r[1-3]5$"), "regexp_matches(rule_id, '^R[1-3]5$')"),
    "f14_is_null": (where("status", "IS_NULL"), "TRUE"),
    "f15_is_not_null": (where("rule_id", "IS_NOT_NULL"), "rule_id IS NOT NULL"),
    "f16_length_lt": (where("rule_id", "LENGTH_LT", 3), "length(rule_id) < 3"),
    "f17_length_gt": (where("rule_id", "LENGTH_GT", 2), "length(rule_id) > 2"),
    "f18_lower_in": (where("severity", "LOWER_IN", ["CRITICAL", "medium"]), "severity IN ('CRITICAL', 'MEDIUM')"),
    "f19_and": (all_of(where("severity", "EQ", "HIGH"), where("value", "GT", 50)), "severity = 'HIGH' AND value > 50"),
    "f20_or": (any_of(where("severity", "EQ", "LOW"), where("rule_id", "EQ", "r5")), "severity = 'LOW' OR rule_id = 'R5'"),
    "f21_not": (none_of(where("severity", "EQ", "LOW"), where("severity", "EQ", "HIGH")), "NOT (severity = 'LOW' OR severity = 'HIGH')"),
}
ALERT_VALUES = """valued AS (SELECT a.*, e.value FROM alerts a JOIN ev e USING (event_id))"""


def _operator(name: str, condition: Condition, predicate: str) -> None:
    sql = with_sql("alerts", extra=ALERT_VALUES, body=f"SELECT entity_id, count(*) AS hits FROM valued WHERE {predicate} GROUP BY entity_id")

    @query(name, sql)
    def run(spark, sf):
        # `value` stays a payload entry, so numeric operators also exercise the text path
        raw = spark.read.parquet(f"{sf}/events.parquet").select(
            F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"), "value"
        )
        rows = alerts(spark, sf).join(raw, "event_id").withColumn(
            "normalized_payload", F.create_map(F.lit("Value"), F.col("value").cast("string"))
        ).drop("value")
        return rows.where(compile_condition(condition, rows)).groupBy("entity_id").agg(F.count("*").alias("hits"))


for _name, (_condition, _predicate) in OPERATOR_CASES.items():
    _operator(_name, _condition, _predicate)


@query(
    "f22_off_hours",
    with_sql("alerts", body="""SELECT entity_id, count(*) FILTER (WHERE isodow(ts) >= 6) AS weekend,
  count(*) FILTER (WHERE hour(ts) < 8 OR hour(ts) >= 18) AS night FROM alerts GROUP BY entity_id"""),
)
def f22(spark, sf):
    return alerts(spark, sf).groupBy("entity_id").agg(
        F.count_if(is_weekend("event_timestamp")).alias("weekend"), F.count_if(is_night("event_timestamp")).alias("night")
    )


@query(
    "f23_listing_filter",
    with_sql("alerts", body="""SELECT entity_id, event_id, severity FROM alerts
WHERE entity_id = '7' AND severity = 'HIGH' AND rule_id LIKE '%R%' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-31'"""),
)
def f23(spark, sf):
    return listing_filter(
        alerts(spark, sf), {"entity_id": "7", "asset_id": None}, {"severity": "high"},
        ("r", ("rule_id", "action")), ("event_timestamp", datetime(2024, 1, 10), datetime(2024, 1, 31)),
    ).select("entity_id", "event_id", "severity")


def orders_gaps(spark, sf):
    events = cases(spark, sf).unionByName(case_followups(spark, sf)).unionByName(case_escalations(spark, sf))
    return eg.stale_cases(events, RULES.get("EG-03"), ORDERS_PERIOD).unionByName(
        eg.escalation_breaches(events, RULES.get("EG-02"), ORDERS_PERIOD)
    )


def orders_absences(spark, sf):
    """Closure deficits; at the given limit no entity has one."""
    return closure_deficit(cases(spark, sf), check_registry().get("NS-04"), ORDERS_PERIOD)


@query(
    "f24_finding_search",
    with_sql("entities", "cases", "lines", extra=",\n".join((EG02, EG03)), body="""
SELECT g.entity_id, g.subject, g.rule_id FROM (SELECT * FROM eg02 UNION ALL SELECT * FROM eg03) g
JOIN entities e USING (entity_id)
WHERE contains(lower(CASE rule_id WHEN 'EG-02' THEN 'Missing Escalation After Severity Threshold' ELSE 'Stale Open Cases' END || chr(10) || rule_id || chr(10) || e.name || chr(10) || description), 'delayed (1')"""),
)
def f24(spark, sf):
    gaps = orders_gaps(spark, sf)
    absences = orders_absences(spark, sf)
    return search_findings(unified_findings(entities(spark, sf), gaps, absences), "Delayed (1").select(
        "entity_id", F.col("evidence_record_ids")[0].alias("subject"), F.col("rule_or_check_id").alias("rule_id")
    )


@query(
    "a12_grouped_findings",
    with_sql("entities", "cases", "lines", extra=",\n".join((EG02, EG03)), body="""
SELECT rule_id AS rule_or_check_id, CASE rule_id WHEN 'EG-02' THEN 'Missing Escalation After Severity Threshold' ELSE 'Stale Open Cases' END AS title,
  count(*) AS finding_count, CAST(sum(n_evidence) AS BIGINT) AS evidence_total
FROM (SELECT * FROM eg02 UNION ALL SELECT * FROM eg03) GROUP BY 1, 2"""),
)
def a12(spark, sf):
    return grouped_findings(
        unified_findings(entities(spark, sf), orders_gaps(spark, sf), orders_absences(spark, sf))
    )
