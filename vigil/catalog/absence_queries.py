"""Queries for entity statistics and absence checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.catalog.families import (
    EVENTS_PERIOD,
    LATE_PERIOD,
    ORDERS_PERIOD,
    activity,
    alerts,
    asset_alerts,
    assets,
    cases,
    coverage,
    escalations,
    incidents,
    telemetry,
    with_sql,
)
from vigil.catalog.registry import query
from vigil.functions.stats import sample_weight
from vigil.operators import absence as ns
from vigil.operators.rules import check_registry
from vigil.schema import of_type

CHECKS = check_registry()
ALL_EVENTS = "SELECT entity_id, ts, event_id, n FROM alerts UNION ALL SELECT entity_id, ts, event_id, n FROM inv UNION ALL SELECT entity_id, ts, event_id, n FROM act UNION ALL SELECT entity_id, ts, event_id, n FROM esc UNION ALL SELECT entity_id, ts, event_id, n FROM inc"
EVENT_FAMILIES = ("alerts", "inv", "act", "esc", "inc")


@query(
    "a1_daily_volume",
    with_sql("ev", body="SELECT entity_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS volume FROM ev GROUP BY 1, 2"),
)
def daily_volume(spark, sf):
    return ns.daily_volume(telemetry(spark, sf)).select("entity_id", F.col("day").cast("string").alias("day"), "volume")


@query(
    "a1_daily_volume_zero_filled",
    with_sql("ev", body="""SELECT d.entity_id, strftime(d.day, '%Y-%m-%d') AS day, count(e.event_id) AS volume
FROM (SELECT entity_id, unnest(generate_series(min(CAST(ts AS DATE)), (SELECT max(CAST(ts AS DATE)) FROM ev), INTERVAL 1 DAY)) AS day FROM ev GROUP BY entity_id) d
LEFT JOIN ev e ON e.entity_id = d.entity_id AND CAST(e.ts AS DATE) = d.day GROUP BY 1, 2"""),
)
def daily_volume_filled(spark, sf):
    return ns.daily_volume(telemetry(spark, sf), zero_fill=True).select(
        "entity_id", F.col("day").cast("string").alias("day"), "volume"
    )


ENTROPY = """counted AS (SELECT entity_id, rule_id, count(*) AS c FROM alerts GROUP BY 1, 2),
total AS (SELECT entity_id, sum(c) AS n, count(*) AS m FROM counted GROUP BY 1),
entropy AS (SELECT t.entity_id, CAST(any_value(n) AS BIGINT) AS samples, any_value(m) AS categories,
  CASE WHEN any_value(m) > 1 THEN round(-sum((c / n) * log2(c / n)), 4) ELSE 0.0 END AS entropy,
  CASE WHEN any_value(m) > 1 THEN round(log2(any_value(m)), 4) ELSE 0.0 END AS max_entropy
  FROM counted JOIN total t USING (entity_id) GROUP BY t.entity_id)"""


@query("a2_category_entropy", with_sql("alerts", extra=ENTROPY, body="SELECT * FROM entropy"))
def entropy(spark, sf):
    return ns.category_entropy(alerts(spark, sf), ns.rule_label())


ARRIVAL = """gaps AS (SELECT entity_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY ts))) / 1e6 AS d FROM alerts),
arrival AS (SELECT entity_id, count(*) AS samples,
  CASE WHEN count(*) < 2 THEN 1.0 WHEN avg(d) <= 0 THEN 0.0 ELSE round(coalesce(stddev_samp(d), 0) / avg(d), 5) END AS cv,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE round(avg(d), 2) END AS mean_seconds,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE round(coalesce(stddev_samp(d), 0), 2) END AS std_seconds FROM gaps GROUP BY entity_id)"""


@query("a3_inter_arrival", with_sql("alerts", extra=ARRIVAL, body="SELECT * FROM arrival"))
def inter_arrival(spark, sf):
    return ns.inter_arrival(alerts(spark, sf))


@query(
    "w3_gap_to_previous",
    with_sql("alerts", body="""SELECT entity_id, asset_id, event_id,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id, asset_id, CAST(ts AS DATE) ORDER BY ts))) / 1e6 AS gap_seconds FROM alerts"""),
)
def gap_to_previous(spark, sf):
    order = W.partitionBy("entity_id", "asset_id", F.to_date("event_timestamp")).orderBy("event_timestamp")
    micros = F.unix_micros("event_timestamp")
    return alerts(spark, sf).select(
        "entity_id", "asset_id", "event_id", ((micros - F.lag(micros).over(order)) / F.lit(1e6)).alias("gap_seconds")
    )


COUNTERS = """SELECT entity_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS alerts,
  count(*) FILTER (WHERE event_type = 'error' AND isodow(ts) >= 6) AS weekend_alerts,
  count(*) FILTER (WHERE event_type = 'view' AND isodow(ts) >= 6) AS weekend_activities,
  count(*) FILTER (WHERE event_type = 'error' AND value >= 35) AS high_alerts,
  count(*) FILTER (WHERE event_type = 'signup') AS escalations,
  CAST(0 AS BIGINT) AS cases, CAST(0 AS BIGINT) AS closed_cases FROM ev GROUP BY entity_id"""


@query("a4_conditional_counts", with_sql("ev", body=COUNTERS))
def counters(spark, sf):
    return ns.entity_counters(telemetry(spark, sf))


# --- EWMA and the volume cliff --------------------------------------------------------------------

EWMA = """daily AS (SELECT entity_id, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM ev GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day) AS r, count(*) OVER (PARTITION BY entity_id) AS days FROM daily),
fold AS (
  SELECT entity_id, r, days, v AS mu, CAST(0 AS DOUBLE) AS var FROM ranked WHERE r = 1
  UNION ALL
  SELECT f.entity_id, k.r, f.days, 0.2 * k.v + 0.8 * f.mu,
    0.2 * pow(k.v - (0.2 * k.v + 0.8 * f.mu), 2) + 0.8 * f.var
  FROM fold f JOIN ranked k ON k.entity_id = f.entity_id AND k.r = f.r + 1),
base AS (SELECT f.entity_id, f.mu, sqrt(f.var) AS sigma, k.v AS latest, k.day, k.days FROM fold f
  JOIN ranked k ON k.entity_id = f.entity_id AND k.r = k.days AND f.r = k.days - 1 WHERE k.days >= 5),
cliffs AS (SELECT *, CASE WHEN mu > 0 THEN greatest(0.0, (mu - latest) / mu * 100.0) ELSE 0.0 END AS drop_pct,
  mu - 3 * sigma AS threshold FROM base)"""
CLIFF_ROWS = """SELECT entity_id, strftime(day, '%Y-%m-%d') AS latest_day, days - 1 AS history_days, round(mu, 2) AS expected_volume,
  round(latest, 2) AS observed_volume, round(sigma, 2) AS sigma, round(drop_pct, 2) AS drop_percentage,
  round(threshold, 2) AS cliff_threshold, (latest < threshold OR (mu >= 10 AND drop_pct >= 60)) AS is_finding FROM cliffs"""


def absence_rows(findings: DataFrame) -> DataFrame:
    return findings.select(
        "entity_id", "check_id", "severity", F.col("severity_score").cast("bigint").alias("severity_score"),
        "expected_volume", "observed_volume", "drop_percentage", "is_degraded", "degradation_factor",
        "rationale", F.array_join("evidence_record_ids", ",").alias("evidence"),
    )


def ns_sql(code, score, severity, expected, observed, drop, rationale, evidence="evidence", weight="1.0") -> str:
    return f"""SELECT entity_id, '{code}' AS check_id, {severity} AS severity, CAST({score} AS BIGINT) AS severity_score,
  CAST({expected} AS DOUBLE) AS expected_volume, CAST({observed} AS DOUBLE) AS observed_volume, CAST({drop} AS DOUBLE) AS drop_percentage,
  CAST({weight} AS DOUBLE) < 1.0 AS is_degraded, CAST({weight} AS DOUBLE) AS degradation_factor, {rationale} AS rationale, {evidence} AS evidence"""


def top20(source: str, where: str = "TRUE") -> str:
    return f"""(SELECT entity_id, string_agg(event_id, ',' ORDER BY r) AS evidence FROM (
    SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts, n, event_id) AS r FROM ({source}) WHERE {where}) WHERE r <= 20 GROUP BY 1)"""


@query("ns01_volume_cliff", with_sql("ev", extra=EWMA, body=CLIFF_ROWS, recursive=True))
def cliffs(spark, sf):
    return ns.volume_cliffs(telemetry(spark, sf)).withColumn("latest_day", F.col("latest_day").cast("string")).withColumn(
        "history_days", F.col("history_days").cast("bigint")
    )


@query(
    "ns01_findings",
    with_sql("ev", extra=EWMA.replace("mu - 3 * sigma", "mu - 0.5 * sigma"), recursive=True, body=ns_sql(
        "NS-01", 85, "'CRITICAL'", "round(mu, 2)", "round(latest, 2)", "round(drop_pct, 2)",
        "'Daily telemetry volume dropped from expected baseline of ' || round(mu, 2) || ' to ' || round(latest, 2) || ' (' || round(drop_pct, 2) || '% reduction, exceeding 3-sigma cliff threshold of ' || round(threshold, 2) || ').'",
    ) + f""" FROM cliffs JOIN {top20("SELECT ev.* FROM ev JOIN cliffs ON cliffs.entity_id = ev.entity_id AND CAST(ev.ts AS DATE) = cliffs.day")} USING (entity_id)
WHERE latest < threshold OR (mu >= 10 AND drop_pct >= 60)"""),
)
def cliff_findings(spark, sf):
    return absence_rows(ns.volume_cliff_findings(telemetry(spark, sf), CHECKS.get("NS-01"), EVENTS_PERIOD, k=0.5))


@query(
    "ns02_weekend_silence",
    with_sql("alerts", "esc", body=ns_sql(
        "NS-02", 80, "'HIGH'", "w", 0, 100,
        "'During weekend evaluation period, ' || w || ' security alerts fired with 0 analyst console activity or triage audit logs.'",
    ) + f""" FROM (SELECT entity_id, count(*) AS w FROM alerts WHERE isodow(ts) >= 6 GROUP BY 1) JOIN {top20("SELECT * FROM alerts", "isodow(ts) >= 6")} USING (entity_id) WHERE w >= 20"""),
)
def weekend_silence(spark, sf):
    # no analyst activity is submitted at all
    events = alerts(spark, sf).unionByName(escalations(spark, sf))
    return absence_rows(ns.weekend_silence(events, CHECKS.get("NS-02"), EVENTS_PERIOD))


SILENT = """jewels AS (SELECT * FROM assets WHERE tier IN ('CROWN_JEWEL', 'CRITICAL', 'TIER_1', 'TIER-1')),
seen AS (SELECT DISTINCT entity_id, asset_id AS k FROM coverage),
silent AS (SELECT * FROM jewels j WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.entity_id = j.entity_id AND s.k IN (j.asset_id, j.hostname))),
counts AS (SELECT entity_id, count(*) AS total, (SELECT count(*) FROM silent s WHERE s.entity_id = j.entity_id) AS silent FROM jewels j GROUP BY 1),
refs AS (SELECT entity_id, string_agg(event_id, ',' ORDER BY r) AS evidence, string_agg(asset_id, ', ' ORDER BY r) FILTER (WHERE r <= 5) AS top5
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n) AS r FROM silent) GROUP BY 1)"""


@query(
    "ns03_uncovered_jewels",
    with_sql("assets", "coverage", extra=SILENT, body=ns_sql(
        "NS-03", 95, "'CRITICAL'", "total", "total - silent", "round(silent / total * 100.0, 1)",
        "silent || ' out of ' || total || ' Tier-1 Critical assets (' || top5 || ') exhibit total telemetry silence and lack active EDR/WAF/NDR logs.'",
    ) + " FROM counts JOIN refs USING (entity_id)"),
)
def uncovered_jewels(spark, sf):
    events = assets(spark, sf).unionByName(coverage(spark, sf))
    return absence_rows(ns.uncovered_jewels(events, CHECKS.get("NS-03"), ORDERS_PERIOD))


@query("ns03_complete_evidence", with_sql("assets", "coverage", extra=SILENT, body="SELECT entity_id, event_id, asset_id AS asset_ref FROM silent"))
def silent_jewels(spark, sf):
    events = assets(spark, sf).unionByName(coverage(spark, sf))
    return ns.silent_jewels(events).select("entity_id", "event_id", "asset_ref")


@query(
    "u4_telemetry_assets",
    with_sql("coverage", "asset_alerts", body="""SELECT DISTINCT entity_id, asset_id AS asset FROM (
  SELECT entity_id, asset_id FROM coverage WHERE asset_id IS NOT NULL UNION ALL SELECT entity_id, asset_id FROM asset_alerts)"""),
)
def telemetry_assets(spark, sf):
    return ns.telemetry_assets(coverage(spark, sf).unionByName(asset_alerts(spark, sf)))


CLOSURE = """rates AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE status = 'CLOSED') AS closed FROM cases GROUP BY 1),
rated AS (SELECT *, round(closed / n * 100.0, 1) AS rate, CASE WHEN n >= 1000 THEN 1.0 ELSE round(greatest(0.1, n / 1000.0), 4) END AS w FROM rates)"""


@query(
    "ns04_closure_deficit",
    with_sql("cases", extra=CLOSURE, body=ns_sql(
        "NS-04", "round(75 * w)", "CASE WHEN round(75 * w) >= 85 THEN 'CRITICAL' WHEN round(75 * w) >= 70 THEN 'HIGH' WHEN round(75 * w) >= 40 THEN 'MEDIUM' ELSE 'LOW' END",
        "n", "closed", "round(100.0 - rate, 1)",
        "'Over the evaluation period, ' || n || ' cases were opened but only ' || closed || ' were resolved (closure rate ' || rate || '% < 10% threshold).'"
        " || CASE WHEN w < 1 THEN ' [LOW SAMPLE WARNING: Based on N=' || n || ' events, baseline confidence dampened].' ELSE '' END",
        weight="w",
    ) + f" FROM rated JOIN {top20('SELECT * FROM cases')} USING (entity_id) WHERE n >= 30 AND rate < 35"),
)
def closure_deficit(spark, sf):


    check = replace(CHECKS.get("NS-04"), min_sample=1000)  # so that the low-sample weight shows
    return absence_rows(ns.closure_deficit(cases(spark, sf), check, ORDERS_PERIOD, limit=35.0))


@query(
    "ns05_surge_without_escalation",
    with_sql("alerts", "act", body=ns_sql(
        "NS-05", 88, "'CRITICAL'", "h", 0, 100,
        "'A surge of ' || h || ' High/Critical priority alerts occurred during the evaluation window with zero escalations to Tier-2/Tier-3 IR teams.'",
    ) + f""" FROM (SELECT entity_id, count(*) AS h FROM alerts WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1)
JOIN {top20("SELECT * FROM alerts", "severity IN ('CRITICAL', 'HIGH')")} USING (entity_id) WHERE h >= 20"""),
)
def surge(spark, sf):
    # no escalation is submitted at all
    events = alerts(spark, sf).unionByName(activity(spark, sf))
    return absence_rows(ns.surge_without_escalation(events, CHECKS.get("NS-05"), EVENTS_PERIOD))


@query(
    "ns06_rule_monoculture",
    with_sql("alerts", extra=ENTROPY, body=ns_sql(
        "NS-06", 70, "'HIGH'", "max_entropy", "entropy", "round((1.0 - entropy / greatest(0.1, max_entropy)) * 100.0, 1)",
        "'Categorical alert rule distribution exhibits abnormally low Shannon entropy H(X) = ' || entropy || ' bits (< 0.50 bits threshold across N=' || samples || ' alerts and M=' || categories || ' rules), indicating sensor blindness on other attack vectors.'",
    ) + f" FROM entropy JOIN {top20('SELECT * FROM alerts')} USING (entity_id) WHERE samples >= 50 AND entropy < 5.8"),
)
def monoculture(spark, sf):
    return absence_rows(ns.rule_monoculture(alerts(spark, sf), CHECKS.get("NS-06"), EVENTS_PERIOD, limit=5.8))


@query(
    "ns07_synthetic_heartbeat",
    with_sql("alerts", extra=ARRIVAL, body=ns_sql(
        "NS-07", 85, "'CRITICAL'", 1, "cv", "round((1.0 - cv) * 100.0, 1)",
        "'Alert inter-arrival times exhibit near-zero variance (CV = ' || cv || ' < 0.01 threshold, mean delta ' || mean_seconds || 's, sigma ' || std_seconds || 's across N=' || samples || ' alerts), indicating synthetic heartbeat or mock telemetry.'",
    ) + f" FROM arrival JOIN {top20('SELECT * FROM alerts')} USING (entity_id) WHERE samples >= 20 AND cv < 1.0"),
)
def heartbeat(spark, sf):
    return absence_rows(ns.synthetic_heartbeat(alerts(spark, sf), CHECKS.get("NS-07"), EVENTS_PERIOD, limit=1.0))


LATE_END = "TIMESTAMP '2024-02-20 00:00:00'"


@query(
    "ns08_untraced_incidents",
    with_sql("inc", "act", body=ns_sql(
        "NS-08", 65, "'MEDIUM'", 1, 0, 100,
        "'Critical security incident ' || ref || ' was resolved ' || CAST(floor(days) AS BIGINT) || ' days ago without subsequent coverage telemetry updates or post-incident audit reviews.'",
        evidence="event_id",
    ) + f""" FROM (SELECT user_entity AS entity_id, ref, event_id, ts, (epoch_us({LATE_END}) - epoch_us(ts)) / 86400e6 AS days FROM inc) i
WHERE days > 14 AND NOT EXISTS (SELECT 1 FROM act a WHERE a.user_entity = i.entity_id AND a.ts > i.ts)"""),
)
def untraced(spark, sf):
    events = incidents(spark, sf, by_user=True).unionByName(activity(spark, sf, by_user=True))
    return absence_rows(ns.untraced_incidents(events, CHECKS.get("NS-08"), LATE_PERIOD))


@query(
    "check_registry_run",
    with_sql("assets", "coverage", "cases", extra=SILENT, body="""
SELECT entity_id, 'NS-03' AS check_id, CAST(1 AS BIGINT) AS findings FROM counts WHERE silent > 0
UNION ALL SELECT entity_id, 'NS-04', 1 FROM (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE status = 'CLOSED') AS c FROM cases GROUP BY 1)
  WHERE n >= 30 AND round(c / n * 100.0, 1) < 10"""),
)
def check_run(spark, sf):
    registry = check_registry()
    registry.enable("NS-01", False)
    events = assets(spark, sf).unionByName(coverage(spark, sf)).unionByName(cases(spark, sf))
    found = ns.evaluate_checks(events, ORDERS_PERIOD, registry)
    return found.groupBy("entity_id", "check_id").agg(F.count("*").alias("findings"))


@query(
    "x14_sample_weight",
    with_sql("alerts", body="""SELECT entity_id, count(*) AS n, CASE WHEN count(*) >= 90 THEN 1.0 ELSE round(greatest(0.1, count(*) / 90.0), 4) END AS weight
FROM alerts GROUP BY entity_id"""),
)
def weights(spark, sf):
    counts = alerts(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", sample_weight("n", 90))


@query(
    "k4_leading_evidence",
    with_sql("alerts", body=f"SELECT entity_id, evidence FROM {top20('SELECT * FROM alerts')}"),
)
def evidence(spark, sf):
    return ns.leading_evidence(of_type(telemetry(spark, sf), "alert_metadata")).select(
        "entity_id", F.array_join("evidence", ",").alias("evidence")
    )
