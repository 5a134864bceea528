"""Queries for serving views, ordered listings, cards and score history.

The score history is read from the orders table: one score per order of the customer's nation.
Submissions are read from the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.catalog.families import (
    EVENTS_PERIOD,
    ORDERS_PERIOD,
    _case_entities,
    alerts,
    cases,
    entities,
    table,
    tag,
    telemetry,
    utc,
    with_sql,
)
from vigil.catalog.absence_queries import CHECKS
from vigil.catalog.registry import query
from vigil.catalog.rule_queries import EG01, EG02, EG03, RULES, orders_gaps
from vigil.functions.scalars import clamp, risk_tier
from vigil.operators import absence as ns
from vigil.operators import execution_gaps as eg
from vigil.operators import views as vw
from vigil.operators.cards import rationale_cards, shared_cards, with_lineage
from vigil.operators.risk import score_trends


def score_history(spark, sf) -> DataFrame:
    def share(divisor: float):
        return F.round(clamp(F.col("o_totalprice") / divisor, 0.0, 100.0), 2)

    return _case_entities(spark, sf).select(
        tag("O", "o_orderkey").alias("score_id"),
        F.col("c_nationkey").cast("string").alias("entity_id"),
        utc("o_orderdate").alias("calculated_at"),
        share(5000.0).alias("composite_risk_score"),
        share(4000.0).alias("execution_gap_score"),
        share(6000.0).alias("negative_space_score"),
        share(8000.0).alias("peer_deviation_score"),
    ).withColumn("risk_tier", risk_tier("composite_risk_score")).withColumn("trend_direction", F.lit("STABLE"))


def _share(divisor: str) -> str:
    return f"round(least(100.0, greatest(0.0, o_totalprice / {divisor})), 2)"


SCORES = f"""scored AS (SELECT 'O' || o_orderkey AS score_id, CAST(c_nationkey AS VARCHAR) AS entity_id, o_orderdate AS tm,
  {_share('5000.0')} AS composite, {_share('4000.0')} AS gap, {_share('6000.0')} AS absent, {_share('8000.0')} AS peer
  FROM orders JOIN customer ON o_custkey = c_custkey),
scores AS (SELECT *, CASE WHEN composite <= 25 THEN 'LOW' WHEN composite <= 50 THEN 'GUARDED' WHEN composite <= 75 THEN 'ELEVATED' ELSE 'CRITICAL' END AS tier FROM scored),
latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tm DESC, score_id DESC) AS r FROM scores) WHERE r = 1)"""


def submissions(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        tag("F", "doc_id").alias("submission_id"),
        (F.col("doc_id") % 25).cast("string").alias("entity_id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("file_name"),
        F.concat(F.lit("/in/"), F.col("source")).alias("path"),
        F.sha2("text", 256).alias("sha256_hash"),
        F.col("n_chars").alias("row_count"),
        F.length("lang").cast("bigint").alias("quarantined_row_count"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")).alias("uploaded_at"),
    )


SUBMISSIONS = """submissions AS (SELECT 'F' || doc_id AS submission_id, CAST(doc_id % 25 AS VARCHAR) AS entity_id,
  n_chars AS row_count, length(lang) AS bad, TIMESTAMP '2024-01-01' + to_seconds(n_chars) AS tm FROM documents)"""
OPEN_GAPS = ",\n".join((EG02, EG03)) + """,
gaps AS (SELECT * FROM eg02 UNION ALL SELECT * FROM eg03),
deficits AS (SELECT entity_id, n, closed, rate FROM (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE status = 'CLOSED') AS closed,
    round(count(*) FILTER (WHERE status = 'CLOSED') / count(*) * 100.0, 1) AS rate FROM cases GROUP BY 1) WHERE n >= 30 AND rate < 35),
open_n AS (SELECT entity_id, count(*) AS open_findings_count FROM (SELECT entity_id FROM gaps UNION ALL SELECT entity_id FROM deficits) GROUP BY 1)"""
VIEW_FAMILIES = ("entities", "cases", "lines")


def deficits(spark, sf) -> DataFrame:
    return ns.closure_deficit(cases(spark, sf), CHECKS.get("NS-04"), ORDERS_PERIOD, limit=35.0)


@query("w6_latest_scores", f"WITH {SCORES} SELECT entity_id, score_id, composite AS composite_risk_score, tier AS risk_tier FROM latest")
def latest(spark, sf):
    return vw.latest_scores(score_history(spark, sf)).select("entity_id", "score_id", "composite_risk_score", "risk_tier")


@query(
    "w7_sparklines",
    f"""WITH {SCORES} SELECT entity_id, string_agg(format('{{:.2f}}', composite), ',' ORDER BY tm, score_id) AS sparkline FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tm DESC, score_id DESC) AS r FROM scores) WHERE r <= 10 GROUP BY 1""",
)
def sparkline(spark, sf):
    df = vw.sparklines(score_history(spark, sf))
    return df.select(
        "entity_id", F.array_join(F.transform("sparkline", lambda x: F.format_string("%.2f", x)), ",").alias("sparkline")
    )


@query(
    "w11_score_trends",
    f"""WITH {SCORES}, prev AS (SELECT *, lag(composite) OVER (PARTITION BY entity_id ORDER BY tm, score_id) AS p FROM scores)
SELECT entity_id, score_id, CASE WHEN composite - p > 2 THEN 'DETERIORATING' WHEN composite - p < -2 THEN 'IMPROVING' ELSE 'STABLE' END AS trend_direction FROM prev""",
)
def trends(spark, sf):
    return score_trends(score_history(spark, sf)).select("entity_id", "score_id", "trend_direction")


@query(
    "w12_score_chart",
    f"""WITH {SCORES} SELECT entity_id, position, strftime(tm, '%Y-%m-%d') AS date, composite, gap AS execution_gap, absent AS negative_space,
  peer AS peer_deviation, tier FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tm, score_id) AS position FROM scores) WHERE position <= 30""",
)
def chart(spark, sf):
    return vw.score_history(score_history(spark, sf))


@query(
    "x18_radar",
    f"""WITH {SCORES} SELECT entity_id, axis, value, benchmark FROM latest, LATERAL (VALUES
  ('Execution Gap', round(gap, 1), 30.0), ('Negative Space', round(absent, 1), 25.0), ('Peer Deviation', round(peer, 1), 35.0),
  ('Note Plagiarism', round(least(100.0, gap * 0.8), 1), 20.0), ('SLA Breach Rate', round(least(100.0, gap * 1.1), 1), 28.0),
  ('Sensor Silence', round(least(100.0, absent * 1.2), 1), 22.0)) t(axis, value, b), LATERAL (SELECT CAST(b AS DOUBLE) AS benchmark)""",
)
def radar(spark, sf):
    return vw.radar(entities(spark, sf), score_history(spark, sf))


@query("a10_open_findings", with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS, body="SELECT * FROM open_n"))
def open_count(spark, sf):
    return vw.open_findings(orders_gaps(spark, sf), deficits(spark, sf))


@query(
    "vw1_executive_summary",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + SCORES + ",\n" + SUBMISSIONS, body="""SELECT (SELECT count(*) FROM entities) AS total_entities,
  (SELECT count(*) FROM latest WHERE tier = 'CRITICAL' OR composite >= 75) AS critical_risk_entities,
  (SELECT count(*) FROM latest WHERE tier IN ('ELEVATED', 'HIGH') OR (composite >= 50 AND composite < 75)) AS elevated_risk_entities,
  (SELECT round(avg(composite), 2) FROM latest) AS average_risk_score, (SELECT count(*) FROM gaps) AS active_gap_findings,
  (SELECT count(*) FROM deficits) AS active_silence_findings, (SELECT count(*) FROM submissions) AS total_submissions,
  (SELECT CAST(sum(bad) AS BIGINT) FROM submissions) AS total_quarantined_rows"""),
)
def summary(spark, sf):
    return vw.executive_summary(
        entities(spark, sf), score_history(spark, sf), orders_gaps(spark, sf), deficits(spark, sf), submissions(spark, sf)
    )


@query(
    "vw2_worklist",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + SCORES + ",\n" + SUBMISSIONS, body=f"""SELECT e.entity_id, e.entity_code, e.name, e.sector, e.size_tier,
  composite AS composite_risk_score, gap AS execution_gap_score, absent AS negative_space_score, peer AS peer_deviation_score,
  tier AS risk_tier, 'STABLE' AS trend_direction, coalesce(open_findings_count, 0) AS open_findings_count,
  strftime((SELECT max(tm) FROM submissions s WHERE s.entity_id = e.entity_id), '%Y-%m-%d %H:%M:%S') AS last_submission_date
FROM entities e JOIN latest l ON l.entity_id = e.entity_id LEFT JOIN open_n o ON o.entity_id = e.entity_id ORDER BY composite DESC, e.entity_id LIMIT 20"""),
)
def worklist(spark, sf):
    df = vw.worklist(
        entities(spark, sf), score_history(spark, sf), orders_gaps(spark, sf), deficits(spark, sf), submissions(spark, sf),
        limit=20,
    )
    return df.drop("sparkline").withColumn("last_submission_date", F.date_format("last_submission_date", "yyyy-MM-dd HH:mm:ss"))


@query(
    "vw3_entity_list",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + SCORES, body="""SELECT e.entity_id, e.entity_code, e.sector, e.size_tier,
  composite AS composite_risk_score, tier AS risk_tier, coalesce(open_findings_count, 0) AS open_findings_count
FROM entities e LEFT JOIN latest l ON l.entity_id = e.entity_id LEFT JOIN open_n o ON o.entity_id = e.entity_id"""),
)
def entity_list(spark, sf):
    df = vw.entity_list(entities(spark, sf), score_history(spark, sf), orders_gaps(spark, sf), deficits(spark, sf))
    return df.select(
        "entity_id", "entity_code", "sector", "size_tier", "composite_risk_score", "risk_tier", "open_findings_count"
    )


@query(
    "k3_score_page",
    f"""WITH {SCORES} SELECT entity_id, score_id, composite AS composite_risk_score FROM scores ORDER BY tm DESC, score_id LIMIT 100 OFFSET 200""",
)
def score_page(spark, sf):
    return vw.page(score_history(spark, sf), F.desc("calculated_at"), "score_id", offset=200, limit=100).select(
        "entity_id", "score_id", "composite_risk_score"
    )


UNIFIED = """rows_ AS (
  SELECT g.entity_id, name AS entity_name, 'EXECUTION_GAP' AS engine, rule_id AS rule_or_check_id, severity, 'OPEN' AS status, description, 0.95 AS confidence, subject
  FROM gaps g JOIN entities USING (entity_id)
  UNION ALL SELECT d.entity_id, name, 'NEGATIVE_SPACE', 'NS-04', 'HIGH', 'OPEN',
    'Observed volume ' || CAST(closed AS DOUBLE) || ' dropped ' || round(100.0 - rate, 1) || '% vs expected baseline ' || CAST(n AS DOUBLE), 0.90, NULL
  FROM deficits d JOIN entities USING (entity_id))"""


def unified(spark, sf) -> DataFrame:
    return vw.unified_findings(entities(spark, sf), orders_gaps(spark, sf), deficits(spark, sf))


@query(
    "u2_unified_findings",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + UNIFIED, body="""SELECT entity_id, entity_name, engine, rule_or_check_id, severity, status, description,
  CAST(confidence AS DOUBLE) AS confidence FROM rows_"""),
)
def unified_rows(spark, sf):
    return unified(spark, sf).select(
        "entity_id", "entity_name", "engine", "rule_or_check_id", "severity", "status", "description", "confidence"
    )


@query(
    "k2_finding_page",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + UNIFIED, body="""SELECT engine, severity, count(*) AS n FROM (
  SELECT * FROM rows_ WHERE engine = 'EXECUTION_GAP' AND severity = 'CRITICAL' LIMIT 50 OFFSET 100) GROUP BY 1, 2"""),
)
def finding_page(spark, sf):
    df = vw.list_findings(unified(spark, sf), engine="gap", severity="critical", status="open", offset=100, limit=50)
    return df.groupBy("engine", "severity").agg(F.count("*").alias("n"))


@query(
    "j13_evidence_events",
    with_sql("alerts", "inv", extra=EG01, body="SELECT a.entity_id, a.event_id, a.severity, a.asset_id FROM eg01 JOIN alerts a ON a.event_id = eg01.subject"),
)
def evidence(spark, sf):
    events = telemetry(spark, sf)
    found = eg.uninvestigated_alerts(events, RULES.get("EG-01"), EVENTS_PERIOD)
    return vw.evidence_events(found, events).select("entity_id", "event_id", "severity", "asset_id")


@query(
    "k7_raw_diff",
    with_sql("cases", extra="""deficits AS (SELECT entity_id FROM (SELECT entity_id, count(*) AS n,
    round(count(*) FILTER (WHERE status = 'CLOSED') / count(*) * 100.0, 1) AS rate FROM cases GROUP BY 1) WHERE n >= 30 AND rate < 35),
q AS (SELECT doc_id, CAST(doc_id % 25 AS VARCHAR) AS entity_id, 'Q' || doc_id AS quarantine_id, n_chars FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n_chars DESC, quarantine_id DESC) AS r FROM q)""",
        body="SELECT entity_id, quarantine_id, r AS rank FROM ranked JOIN deficits USING (entity_id) WHERE r <= 10"),
)
def raw_diff(spark, sf):
    quarantined = table(spark, sf, "documents").select(
        tag("Q", "doc_id").alias("quarantine_id"), (F.col("doc_id") % 25).cast("string").alias("entity_id"),
        F.col("doc_id").alias("row_index"), F.col("lang").alias("failure_reason"),
        F.array("source").alias("failed_fields"), F.create_map(F.lit("text"), F.col("text")).alias("raw_content"),
        F.timestamp_seconds("n_chars").alias("quarantined_at"),
    )
    return vw.raw_diff(deficits(spark, sf), quarantined).select(
        "entity_id", "quarantine_id", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "a7_score_distributions",
    with_sql("entities", extra=SCORES, body="""SELECT sector, size_tier, count(*) AS peer_group_size, round(avg(composite), 2) AS mean_risk_score,
  round(list_sort(list(composite))[1 + CAST(floor(count(*) * 0.25) AS INT)], 2) AS p25, round(list_sort(list(composite))[1 + CAST(floor(count(*) * 0.5) AS INT)], 2) AS p50,
  round(list_sort(list(composite))[1 + CAST(floor(count(*) * 0.75) AS INT)], 2) AS p75, round(list_sort(list(composite))[1 + CAST(floor(count(*) * 0.9) AS INT)], 2) AS p90,
  count(*) < 3 AS is_low_confidence FROM entities JOIN latest USING (entity_id) GROUP BY 1, 2"""),
)
def distributions(spark, sf):
    return vw.score_distributions(entities(spark, sf), score_history(spark, sf)).drop("entities")


@query(
    "a8_score_z_scores",
    with_sql("entities", extra=SCORES, body="""SELECT entity_id, composite AS risk_score, round(m, 2) AS sector_mean, z AS z_score, abs(z) >= 2 AS is_outlier, n < 3 AS is_low_confidence, n AS peer_group_size
FROM (SELECT *, CASE WHEN sd > 0.01 THEN round((composite - m) / sd, 2) ELSE 0.0 END AS z FROM (
  SELECT entity_id, composite, avg(composite) OVER w AS m, stddev_pop(composite) OVER w AS sd, count(*) OVER w AS n
  FROM entities JOIN latest USING (entity_id) WINDOW w AS (PARTITION BY sector, size_tier)))"""),
)
def z_scores(spark, sf):
    return vw.score_z_scores(entities(spark, sf), score_history(spark, sf)).select(
        "entity_id", "risk_score", "sector_mean", "z_score", "is_outlier", "is_low_confidence", "peer_group_size"
    )


REPORT_PICK = """recent AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tm DESC, id) AS recency FROM src),
cut AS (SELECT *, row_number() OVER (PARTITION BY entity_id, rule ORDER BY recency) AS in_rule, min(recency) OVER (PARTITION BY entity_id, rule) AS seen FROM recent WHERE recency <= 50),
placed AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN in_rule > 1 THEN 1 ELSE 0 END, seen, in_rule) AS position FROM cut)"""


@query(
    "w8_report_pick",
    "WITH src AS (SELECT CAST(user_id % 25 AS VARCHAR) AS entity_id, 'E' || event_id AS id, event_type AS rule, ts AS tm FROM events),\n"
    + REPORT_PICK + " SELECT entity_id, rule AS rule_id, id AS finding_id, position FROM placed WHERE in_rule = 1 OR position <= 10",
)
def report_pick(spark, sf):
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 25).cast("string").alias("entity_id"), tag("E", "event_id").alias("finding_id"),
        F.col("event_type").alias("rule_id"), utc("ts").alias("period_end"),
    )
    return vw.report_findings(rows).select("entity_id", "rule_id", "finding_id", F.col("position").cast("bigint").alias("position"))


CARDS = OPEN_GAPS + """,
cards AS (SELECT entity_id, 'EXECUTION_GAP' AS engine_name, rule_id AS rule_code, severity, CAST(score AS BIGINT) AS severity_score, rationale AS summary_narrative, CAST(n_evidence AS VARCHAR) AS evidence_count FROM gaps
UNION ALL SELECT entity_id, 'NEGATIVE_SPACE', 'NS-04', 'HIGH', 75, 'Over the evaluation period, ' || n || ' cases were opened but only ' || closed || ' were resolved (closure rate ' || rate || '% < 10% threshold).', NULL FROM deficits)"""


def cards(spark, sf) -> DataFrame:
    return rationale_cards(orders_gaps(spark, sf), deficits(spark, sf))


@query("r6_rationale_cards", with_sql(*VIEW_FAMILIES, extra=CARDS, body="SELECT * FROM cards"))
def card_rows(spark, sf):
    return cards(spark, sf).select(
        "entity_id", "engine_name", "rule_code", "severity", F.col("severity_score").cast("bigint").alias("severity_score"),
        "summary_narrative", F.col("technical_details")["evidence_count"].alias("evidence_count"),
    )


@query(
    "r7_shared_cards",
    with_sql(*VIEW_FAMILIES, extra=CARDS, body="SELECT engine_name AS category, severity, summary_narrative AS rationale_text FROM cards"),
)
def shared(spark, sf):
    return shared_cards(cards(spark, sf)).select("category", "severity", "rationale_text")


@query(
    "j16_card_lineage",
    with_sql("alerts", "inv", extra=EG01, body="SELECT a.entity_id, a.event_id, CAST(a.n AS VARCHAR) AS raw_rows FROM eg01 JOIN alerts a ON a.event_id = eg01.subject"),
)
def lineage(spark, sf):
    events = alerts(spark, sf)
    found = eg.uninvestigated_alerts(telemetry(spark, sf), RULES.get("EG-01"), EVENTS_PERIOD)
    blank = found.withColumn("raw_row_indices", F.array().cast("array<bigint>"))
    none = deficits(spark, sf).where(F.lit(False))
    return with_lineage(rationale_cards(blank, none), events).select(
        "entity_id", F.col("evidence_record_ids")[0].alias("event_id"),
        F.array_join(F.col("raw_row_indices").cast("array<string>"), ",").alias("raw_rows"),
    )


@query(
    "vw7_compliance_reports",
    with_sql(*VIEW_FAMILIES, extra=OPEN_GAPS + ",\n" + SCORES, body="""SELECT e.entity_id, composite AS composite_risk_score, tier AS risk_tier,
  CAST(least(10, (SELECT count(*) FROM gaps g WHERE g.entity_id = e.entity_id)) AS BIGINT) AS critical_findings,
  (SELECT count(*) FROM deficits d WHERE d.entity_id = e.entity_id) AS sensor_silence_findings,
  'Supervisory cyber audit for ' || name || ' (' || entity_code || ') operating in sector ' || sector || ' (' || size_tier || '). Evaluated risk score: ' || composite || '/100 (' || tier || '). Detected '
  || least(10, (SELECT count(*) FROM gaps g WHERE g.entity_id = e.entity_id)) || ' execution gap violations and ' || (SELECT count(*) FROM deficits d WHERE d.entity_id = e.entity_id)
  || ' negative space anomalies. Cryptographic SHA-256 Merkle root generated and verified.' AS executive_summary
FROM entities e JOIN latest USING (entity_id)"""),
)
def reports(spark, sf):
    sealed = entities(spark, sf).select(
        "entity_id", F.lit("m").alias("manifest_id"), F.sha2("name", 256).alias("root_merkle_sha256"),
        F.lit(1).alias("file_count"), F.lit(1).alias("event_count"), F.lit(1).alias("finding_count"),
        F.lit(ORDERS_PERIOD.end).alias("generated_at"),
    )
    df = vw.compliance_reports(
        entities(spark, sf), score_history(spark, sf), orders_gaps(spark, sf), deficits(spark, sf), sealed, ORDERS_PERIOD.end
    )
    return df.select(
        "entity_id", "composite_risk_score", "risk_tier",
        F.coalesce(F.size("critical_findings"), F.lit(0)).cast("bigint").alias("critical_findings"),
        F.coalesce(F.size("sensor_silence_findings"), F.lit(0)).cast("bigint").alias("sensor_silence_findings"),
        "executive_summary",
    )
