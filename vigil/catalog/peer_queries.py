"""Queries for correlation, peer benchmarking and risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.catalog.families import (
    EVENTS_PERIOD,
    ORDERS_PERIOD,
    alerts,
    assets,
    case_followups,
    cases,
    coverage,
    entities,
    notes,
    table,
    telemetry,
    with_sql,
)
from vigil.catalog.registry import query
from vigil.catalog.rule_queries import EG01, EG03, EG06, EG08, RULES
from vigil.functions.text import STOP_WORDS, jaccard, tokens
from vigil.operators import execution_gaps as eg
from vigil.operators import notes as nt
from vigil.operators import peers as pr
from vigil.operators.absence import evaluate_checks
from vigil.operators.bursts import burst_edges, find_bursts
from vigil.operators.correlation import correlate
from vigil.operators.risk import absence_subscores, gap_subscores, risk_scores
from vigil.operators.rules import check_registry, rule_registry
from vigil.schema import of_type
from vigil.session import cut_lineage, settled, stored

# --- bursts ---------------------------------------------------------------------------------------

BURSTS = """pool AS (SELECT entity_id, asset_id, event_id, n, ts, rule_id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END AS high FROM alerts),
cand AS (SELECT a.entity_id, a.asset_id, a.ts FROM pool a JOIN pool b
    ON b.entity_id = a.entity_id AND b.asset_id = a.asset_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR
  GROUP BY a.entity_id, a.asset_id, a.ts, a.event_id HAVING count(*) >= {n} OR sum(b.high) >= {h}),
jump AS (SELECT c.entity_id, c.asset_id, c.ts, (SELECT min(k.ts) FROM cand k WHERE k.entity_id = c.entity_id
    AND k.asset_id = c.asset_id AND k.ts > c.ts + INTERVAL 24 HOUR) AS nxt FROM (SELECT DISTINCT * FROM cand) c),
chain AS (SELECT entity_id, asset_id, min(ts) AS s FROM cand GROUP BY 1, 2
  UNION ALL SELECT c.entity_id, c.asset_id, j.nxt FROM chain c JOIN jump j ON j.entity_id = c.entity_id AND j.asset_id = c.asset_id
    AND j.ts = c.s WHERE j.nxt IS NOT NULL),
member AS (SELECT c.entity_id, c.asset_id, c.s, p.event_id, p.ts, p.n, p.high, p.rule_id,
    row_number() OVER (PARTITION BY c.entity_id, c.asset_id, c.s ORDER BY p.ts, p.n, p.event_id) AS r
  FROM chain c JOIN pool p ON p.entity_id = c.entity_id AND p.asset_id = c.asset_id AND p.ts >= c.s AND p.ts <= c.s + INTERVAL 24 HOUR)"""
DEFAULT_BURSTS = BURSTS.format(n=5, h=3)
LOOSE_BURSTS = BURSTS.format(n=3, h=2)
STAMP = "'%Y-%m-%d %H:%M:%S'"


def cluster_rows(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        "entity_id", "asset_id", "alert_count", "high_critical_count",
        F.array_join("distinct_rules", ",").alias("rules"),
        F.date_format("time_window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("time_window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
        "first_event_id",
    )


CLUSTERS = f"""SELECT entity_id, asset_id, count(*) AS alert_count, CAST(sum(high) AS BIGINT) AS high_critical_count,
  string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, strftime(min(ts), {STAMP}) AS window_start,
  strftime(max(ts), {STAMP}) AS window_end, arg_min(event_id, r) AS first_event_id FROM member GROUP BY entity_id, asset_id, s"""


@query("c1_burst_clusters", with_sql("alerts", extra=LOOSE_BURSTS, body=CLUSTERS, recursive=True))
def clusters_loose(spark, sf):
    return cluster_rows(find_bursts(alerts(spark, sf), min_alerts=3, min_high=2)[0])


@query("c1_burst_clusters_default", with_sql("alerts", extra=DEFAULT_BURSTS, body=CLUSTERS, recursive=True))
def clusters_default(spark, sf):
    return cluster_rows(find_bursts(alerts(spark, sf))[0])


@query("w2_burst_clusters_doubling", with_sql("alerts", extra=LOOSE_BURSTS, body=CLUSTERS, recursive=True))
def clusters_doubling(spark, sf):
    """Same result by the path meant for very busy assets."""
    return cluster_rows(find_bursts(alerts(spark, sf), min_alerts=3, min_high=2, fold_limit=1)[0])


@query(
    "c2_burst_edges",
    with_sql("alerts", extra=LOOSE_BURSTS, recursive=True, body="""SELECT m.entity_id, m.asset_id, f.event_id AS primary_event_id,
  m.event_id AS correlated_event_id, CAST(1.0 AS DOUBLE) AS similarity_score
FROM member m JOIN member f ON f.entity_id = m.entity_id AND f.asset_id = m.asset_id AND f.s = m.s AND f.r = 1 WHERE m.r > 1"""),
)
def edges(spark, sf):
    clusters, members = find_bursts(alerts(spark, sf), min_alerts=3, min_high=2)
    return burst_edges(clusters, members).select(
        "entity_id", "asset_id", "primary_event_id", "correlated_event_id", "similarity_score"
    )


# --- notes ----------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS if "'" not in w)
NOTE_TOKENS = f"""tokened AS (SELECT entity_id, event_id, case_id, list_filter(
    string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '),
    lambda t: length(t) > 2 AND t NOT IN ({STOP})) AS tokens FROM notes)"""
NOTE_GROUPS = NOTE_TOKENS + """,
corpus AS (SELECT *, sha256(array_to_string(list_sort(tokens), ' ')) AS bag FROM tokened WHERE len(tokens) >= 10),
grouped AS (SELECT entity_id, bag, count(*) AS size, min(event_id) AS rep, any_value(tokens) AS tokens FROM corpus GROUP BY 1, 2)"""
NOTE_PAIRS = NOTE_GROUPS + """,
docs AS (SELECT entity_id, sum(size) AS docs FROM grouped GROUP BY 1),
posting AS (SELECT entity_id, bag, term, count(*) AS tf, any_value(size) AS size FROM (
    SELECT entity_id, bag, size, unnest(tokens) AS term FROM grouped) GROUP BY 1, 2, 3),
df AS (SELECT entity_id, term, sum(size) AS df FROM posting GROUP BY 1, 2),
weighted AS (SELECT p.entity_id, p.bag, p.term, df, p.tf * (ln((1.0 + docs) / (1.0 + df)) + 1.0) AS w
  FROM posting p JOIN df USING (entity_id, term) JOIN docs USING (entity_id)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id, bag)) AS u, count(*) OVER (PARTITION BY entity_id, bag) AS terms FROM weighted),
pairs AS (SELECT a.entity_id, a.bag AS bag_a, b.bag AS bag_b, sum(a.u * b.u) AS cosine,
    count(*) / (any_value(a.terms) + any_value(b.terms) - count(*)) AS jaccard,
    list_slice(list_sort(list(a.term)), 1, 15) AS shared
  FROM unit a JOIN unit b ON a.entity_id = b.entity_id AND a.term = b.term AND a.bag < b.bag GROUP BY 1, 2, 3),
similar_pairs AS (SELECT * FROM pairs WHERE cosine >= 0.595 AND (cosine >= 0.85 OR jaccard >= 0.80))"""


@query(
    "c3_note_corpus",
    with_sql("notes", extra=NOTE_GROUPS, body="SELECT entity_id, event_id, CAST(len(tokens) AS BIGINT) AS n_tokens, bag FROM corpus"),
)
def corpus(spark, sf):
    return nt.note_corpus(notes(spark, sf)).select(
        "entity_id", "event_id", F.size("tokens").cast("bigint").alias("n_tokens"), "bag"
    )


@query(
    "x10_tokens",
    with_sql("notes", extra=NOTE_TOKENS, body="SELECT event_id, sha256(array_to_string(tokens, ' ')) AS tokens_sha256, CAST(len(tokens) AS BIGINT) AS n FROM tokened"),
)
def note_tokens(spark, sf):
    t = notes(spark, sf).select("event_id", tokens("investigation_notes").alias("t"))
    return t.select(
        "event_id", F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"), F.size("t").cast("bigint").alias("n")
    )


@query(
    "c4_term_weights",
    with_sql("notes", extra=NOTE_PAIRS, body="""SELECT entity_id, bag, count(*) AS terms, round(max(u), 6) AS top_weight,
  CAST(sum(df) AS BIGINT) AS df_total, round(sum(u), 4) AS weight_total FROM unit GROUP BY 1, 2"""),
)
def weights(spark, sf):
    w = nt.term_weights(nt.note_groups(nt.note_corpus(notes(spark, sf))))
    return w.groupBy("entity_id", "bag").agg(
        F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top_weight"),
        F.sum("df").alias("df_total"), F.round(F.sum("w"), 4).alias("weight_total"),
    )


@query(
    "c5_similar_notes",
    with_sql("notes", extra=NOTE_PAIRS, body="""SELECT s.entity_id, a.rep AS note_a, b.rep AS note_b, round(cosine, 4) AS cosine,
  round(jaccard, 4) AS jaccard, array_to_string(shared, ' ') AS shared_tokens, a.size * b.size AS pair_count
FROM similar_pairs s JOIN grouped a ON a.entity_id = s.entity_id AND a.bag = s.bag_a JOIN grouped b ON b.entity_id = s.entity_id AND b.bag = s.bag_b"""),
)
def similar_notes(spark, sf):
    return nt.similar_group_edges(settled(nt.with_text(nt.note_corpus(notes(spark, sf))), "notes")).select(
        "entity_id", F.col("rep_a.event_id").alias("note_a"), F.col("rep_b.event_id").alias("note_b"),
        F.round("cosine", 4).alias("cosine"), F.round("jaccard", 4).alias("jaccard"),
        F.array_join("shared_tokens", " ").alias("shared_tokens"), "pair_count",
    )


@query("c6_note_members", with_sql("notes", extra=NOTE_GROUPS, body="SELECT entity_id, bag, event_id, case_id AS case_key FROM corpus"))
def note_members(spark, sf):
    return nt.note_members(nt.note_corpus(notes(spark, sf))).select("entity_id", "bag", "event_id", "case_key")


@query(
    "u5_note_clone_groups",
    with_sql("notes", extra=NOTE_GROUPS, body="SELECT entity_id, bag, size, size AS cases, size * (size - 1) // 2 AS pair_count FROM grouped WHERE size > 1"),
)
def clone_groups(spark, sf):
    return nt.clone_groups(nt.note_corpus(notes(spark, sf)))


@query(
    "c6_correlation_edges",
    with_sql("alerts", "notes", extra=DEFAULT_BURSTS + ",\n" + NOTE_PAIRS, recursive=True, body="""
SELECT m.entity_id, 'REPEAT_ASSET_ALERT' AS correlation_type, f.event_id AS primary_event_id, m.event_id AS correlated_event_id, CAST(1.0 AS DOUBLE) AS similarity_score
FROM member m JOIN member f ON f.entity_id = m.entity_id AND f.asset_id = m.asset_id AND f.s = m.s AND f.r = 1 WHERE m.r > 1
UNION ALL SELECT c.entity_id, 'TFIDF_NOTE_SIMILARITY', g.rep, c.event_id, 1.0 FROM corpus c JOIN grouped g USING (entity_id, bag) WHERE c.event_id <> g.rep
UNION ALL SELECT s.entity_id, 'TFIDF_NOTE_SIMILARITY', a.rep, b.rep, round(greatest(cosine, jaccard), 4)
FROM similar_pairs s JOIN grouped a ON a.entity_id = s.entity_id AND a.bag = s.bag_a JOIN grouped b ON b.entity_id = s.entity_id AND b.bag = s.bag_b"""),
)
def all_edges(spark, sf):
    return correlate(alerts(spark, sf).unionByName(notes(spark, sf)))[0].select(
        "entity_id", "correlation_type", "primary_event_id", "correlated_event_id", "similarity_score"
    )


@query(
    "u3_token_set_similarity",
    with_sql(extra="""s AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.t AS ta, b.t AS tb FROM s a JOIN s b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""", body="""
SELECT conv_id, turn, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS similarity FROM p"""),
)
def token_sets(spark, sf):
    s = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    following = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("tb"))
    return s.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(jaccard("t", "tb"), 6).alias("similarity"))


# --- peer metrics ---------------------------------------------------------------------------------


def peer_events(spark, sf) -> DataFrame:
    return (
        telemetry(spark, sf).unionByName(cases(spark, sf)).unionByName(assets(spark, sf)).unionByName(coverage(spark, sf))
    )


def stale_findings(spark, sf) -> DataFrame:
    return eg.stale_cases(cases(spark, sf).unionByName(case_followups(spark, sf)), RULES.get("EG-03"), ORDERS_PERIOD)


MTTI = """inv_keys AS (SELECT entity_id, alert_id AS ref, ts FROM inv UNION ALL SELECT entity_id, case_id, ts FROM inv),
first_inv AS (SELECT entity_id, ref, min(ts) AS t FROM inv_keys GROUP BY 1, 2),
mtti AS (SELECT a.entity_id, avg(greatest(0.0, (epoch_us(f.t) - epoch_us(a.ts)) / 60e6)) AS mtti
  FROM alerts a JOIN first_inv f USING (entity_id, ref) GROUP BY 1)"""
GAPS = """jewels AS (SELECT * FROM assets WHERE tier IN ('CROWN_JEWEL', 'CRITICAL', 'TIER_1')),
covered AS (SELECT DISTINCT entity_id, asset_id AS k FROM coverage WHERE uptime >= 50),
coverage_gap AS (SELECT entity_id, count(*) AS jewels, count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.entity_id = j.entity_id AND c.k IN (j.asset_id, j.hostname))) AS unmonitored FROM jewels j GROUP BY 1)"""
METRICS = MTTI + ",\n" + GAPS + ",\n" + EG03 + """,
spent AS (SELECT entity_id, avg(minutes) AS spent FROM inv GROUP BY 1),
alert_n AS (SELECT entity_id, count(*) AS alerts FROM alerts GROUP BY 1),
esc_n AS (SELECT entity_id, count(*) AS escalations FROM esc GROUP BY 1),
case_n AS (SELECT entity_id, count(*) AS cases, count(*) FILTER (WHERE status IN ('OPEN', 'IN_PROGRESS')
    AND (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(ts)) / 3600e6 > 72) AS stale FROM cases GROUP BY 1),
gap_n AS (SELECT entity_id, count(*) AS gaps FROM eg03 GROUP BY 1),
metrics AS (SELECT e.entity_id, e.sector, e.size_tier, round(coalesce(mtti, spent, 45.0), 2) AS mtti_minutes,
  round(coalesce(escalations, 0) / greatest(coalesce(alerts, 0), 1), 4) AS escalation_rate,
  round(coalesce(stale, 0) / greatest(coalesce(cases, 0), 1), 4) AS stale_case_ratio,
  round(coalesce(unmonitored, 0) / greatest(coalesce(jewels, 0), 1), 4) AS coverage_gap_ratio,
  round(least(100.0, coalesce(gaps, 0) / greatest(coalesce(cases, 0), coalesce(alerts, 0), 1) * 100.0), 2) AS execution_gap_rate,
  coalesce(alerts, 0) AS total_alerts, coalesce(cases, 0) AS total_cases, coalesce(jewels, 0) AS total_crown_jewels
  FROM entities e LEFT JOIN mtti USING (entity_id) LEFT JOIN spent USING (entity_id) LEFT JOIN alert_n USING (entity_id)
  LEFT JOIN esc_n USING (entity_id) LEFT JOIN case_n USING (entity_id) LEFT JOIN coverage_gap USING (entity_id) LEFT JOIN gap_n USING (entity_id))"""
PEER_FAMILIES = ("entities", "alerts", "inv", "esc", "cases", "lines", "assets", "coverage")


@query("b1_time_to_investigate", with_sql("alerts", "inv", extra=MTTI, body="SELECT entity_id, round(mtti, 6) AS mtti FROM mtti"))
def mtti(spark, sf):
    return pr.time_to_investigate(telemetry(spark, sf)).withColumn("mtti", F.round("mtti", 6))


@query(
    "b3_stale_open_cases",
    with_sql("cases", body="""SELECT entity_id, count(*) FILTER (WHERE (epoch_us(TIMESTAMP '2001-12-01') - epoch_us(ts)) / 3600e6 > 72) AS stale
FROM cases WHERE status IN ('OPEN', 'IN_PROGRESS') GROUP BY 1"""),
)
def stale_open(spark, sf):
    return pr.stale_open_cases(cases(spark, sf), ORDERS_PERIOD.end)


@query("b4_coverage_gaps", with_sql("assets", "coverage", extra=GAPS, body="SELECT * FROM coverage_gap"))
def coverage_gap(spark, sf):
    return pr.coverage_gaps(assets(spark, sf).unionByName(coverage(spark, sf)))


@query("a5_entity_metrics", with_sql(*PEER_FAMILIES, extra=METRICS, body="SELECT * FROM metrics"))
def metrics(spark, sf):
    return pr.entity_metrics(entities(spark, sf), peer_events(spark, sf), stale_findings(spark, sf), ORDERS_PERIOD.end)




def r4(value: str) -> str:
    """Correctly rounded to 4 digits; the plain SQL round scales first and can miss by one digit."""
    return f"CAST(format('{{:.4f}}', {value}) AS DOUBLE)"


def cohorts_sql(k: int) -> str:
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY lower(sector), lower(size_tier)) AS n_exact,
    count(*) OVER (PARTITION BY lower(sector)) AS n_sector, count(*) OVER () AS n_all FROM metrics),
chosen AS (SELECT *, CASE WHEN n_exact >= {k} THEN 'EXACT_COHORT' WHEN n_sector >= {k} THEN 'SECTOR_FALLBACK' WHEN n_all >= {k} THEN 'GLOBAL_FALLBACK' ELSE 'BASELINE_FALLBACK' END AS fallback_applied,
    CASE WHEN n_exact >= {k} THEN n_exact WHEN n_sector >= {k} THEN n_sector ELSE n_all END AS peer_group_size,
    n_exact < {k} AS is_low_confidence, CASE WHEN n_exact >= {k} THEN 1.0 ELSE 0.5 END AS dampening FROM sized),
longm AS (UNPIVOT metrics ON mtti_minutes, escalation_rate, stale_case_ratio, coverage_gap_ratio, execution_gap_rate INTO NAME metric_name VALUE value),
peer AS (SELECT c.entity_id, c.sector, c.size_tier, c.fallback_applied, c.peer_group_size, c.is_low_confidence, c.dampening, t.metric_name, t.value, p.value AS v
  FROM chosen c JOIN longm t ON t.entity_id = c.entity_id JOIN longm p ON p.metric_name = t.metric_name
    AND (CASE c.fallback_applied WHEN 'EXACT_COHORT' THEN p.sector = c.sector AND p.size_tier = c.size_tier
         WHEN 'SECTOR_FALLBACK' THEN p.sector = c.sector ELSE TRUE END)),
bench AS (SELECT entity_id, sector, size_tier, fallback_applied, peer_group_size, is_low_confidence, dampening, metric_name, any_value(value) AS value,
  {r4('avg(v)')} AS mean_val, {r4('greatest(coalesce(stddev_samp(v), 0), 1e-4)')} AS std_dev,
  {r4('quantile_cont(v, 0.25)')} AS p25, {r4('quantile_cont(v, 0.5)')} AS p50, {r4('quantile_cont(v, 0.75)')} AS p75, {r4('quantile_cont(v, 0.9)')} AS p90,
  round((count(*) FILTER (WHERE v < value) + 0.5 * count(*) FILTER (WHERE abs(v - value) <= greatest(1e-5 * greatest(abs(v), abs(value)), 1e-5))) / count(*) * 100.0, 2) AS percentile
  FROM peer GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
zed AS (SELECT *, {r4('(value - mean_val) / greatest(std_dev, 1e-4)')} AS z_score FROM bench),
evaluated AS (SELECT entity_id, any_value(fallback_applied) AS fallback_applied, any_value(peer_group_size) AS peer_group_size,
  round(avg(greatest(-3.5, least(3.5, CASE metric_name WHEN 'escalation_rate' THEN -z_score ELSE z_score END))), 4) AS mean_risk_z_score,
  least(100.0, greatest(0.0, round(50.0 + 25.0 * avg(greatest(-3.5, least(3.5, CASE metric_name WHEN 'escalation_rate' THEN -z_score ELSE z_score END))) * any_value(dampening), 2))) AS peer_deviation_score
  FROM zed GROUP BY 1)"""


@query(
    "b6_cohort_fallback",
    with_sql(*PEER_FAMILIES, extra=METRICS + ",\n" + cohorts_sql(2), body="SELECT entity_id, fallback_applied, peer_group_size, is_low_confidence, CAST(dampening AS DOUBLE) AS dampening_factor FROM chosen"),
)
def cohort_choice(spark, sf):
    m = metrics(spark, sf)
    return pr.choose_cohorts(m, min_peers=2).select(
        "entity_id", "fallback_applied", "peer_group_size", "is_low_confidence", "dampening_factor"
    )


@query(
    "b7_peer_benchmarks",
    with_sql(*PEER_FAMILIES, extra=METRICS + ",\n" + cohorts_sql(3), body="""SELECT entity_id, metric_name, value, fallback_applied, peer_group_size,
  mean_val, std_dev, p25, p50, p75, p90, z_score, percentile FROM zed"""),
)
def benchmarks(spark, sf):
    return pr.benchmark_entities(metrics(spark, sf)).select(
        "entity_id", "metric_name", "value", "fallback_applied", "peer_group_size", "mean_val", "std_dev",
        "p25", "p50", "p75", "p90", "z_score", "percentile",
    )


@query(
    "b8_peer_deviation",
    with_sql(*PEER_FAMILIES, extra=METRICS + ",\n" + cohorts_sql(3), body="SELECT * FROM evaluated"),
)
def deviation(spark, sf):
    return pr.peer_evaluations(pr.benchmark_entities(metrics(spark, sf))).select(
        "entity_id", "fallback_applied", "peer_group_size", "mean_risk_z_score", "peer_deviation_score"
    )


@query(
    "b9_percentile_map",
    with_sql(*PEER_FAMILIES, extra=METRICS + ",\n" + cohorts_sql(3), body="""SELECT entity_id, string_agg(metric_name || '=' || format('{:.2f}', percentile), ',' ORDER BY metric_name) AS percentiles FROM zed GROUP BY 1"""),
)
def percentile_map(spark, sf):
    e = pr.peer_evaluations(pr.benchmark_entities(metrics(spark, sf)))
    items = F.transform(
        F.array_sort(F.map_entries("metric_percentiles")),
        lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.2f", x["value"])),
    )
    return e.select("entity_id", F.array_join(items, ",").alias("percentiles"))


@query(
    "a6_cohort_distribution",
    """SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_val,
  round(greatest(coalesce(stddev_samp(c_acctbal), 0), 1e-4), 4) AS std_dev, round(quantile_cont(c_acctbal, 0.25), 4) AS p25,
  round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.75), 4) AS p75, round(quantile_cont(c_acctbal, 0.9), 4) AS p90
FROM customer GROUP BY 1, 2""",
)
def distribution(spark, sf):
    return pr.cohort_distribution(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")


@query(
    "w10_percentile_ranks",
    """SELECT DISTINCT a.c_mktsegment, a.c_acctbal, round(((SELECT count(*) FROM customer b WHERE b.c_mktsegment = a.c_mktsegment AND b.c_acctbal < a.c_acctbal)
  + 0.5 * (SELECT count(*) FROM customer b WHERE b.c_mktsegment = a.c_mktsegment AND abs(b.c_acctbal - a.c_acctbal) <= greatest(1e-5 * greatest(abs(a.c_acctbal), abs(b.c_acctbal)), 1e-5)))
  / (SELECT count(*) FROM customer b WHERE b.c_mktsegment = a.c_mktsegment) * 100.0, 2) AS percentile FROM customer a""",
)
def ranks(spark, sf):
    return pr.percentile_ranks(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")


@query(
    "x16_sector_baselines",
    with_sql("entities", body="""SELECT DISTINCT sector, metric_name, mean, std FROM entities,
(VALUES ('mtti_minutes', 45.0, 20.0), ('escalation_rate', 0.07, 0.03), ('stale_case_ratio', 0.07, 0.03), ('coverage_gap_ratio', 0.05, 0.02), ('execution_gap_rate', 3.0, 1.5)) t(metric_name, m, s),
LATERAL (SELECT CAST(m AS DOUBLE) AS mean, CAST(s AS DOUBLE) AS std)"""),
)
def baselines(spark, sf):
    mean, std = pr.baseline_columns("sector", "metric_name")
    names = F.explode(F.array(*[F.lit(m) for m in pr.METRICS])).alias("metric_name")
    return entities(spark, sf).select("sector").distinct().select("sector", names).select(
        "sector", "metric_name", mean.alias("mean"), std.alias("std")
    )


# --- risk -----------------------------------------------------------------------------------------

EVENT_GAPS = ",\n".join((EG01, EG06, EG08)) + """,
gaps AS (SELECT entity_id, score, 0.95 AS conf FROM eg01 UNION ALL SELECT entity_id, score, 0.88 FROM eg06 UNION ALL SELECT entity_id, score, 0.90 FROM eg08),
alert_n AS (SELECT entity_id, count(*) AS alerts FROM alerts GROUP BY 1),
gap_score AS (SELECT g.entity_id, count(*) AS gap_count, round(least(100.0, sum(score / 100.0 * conf) * (100.0 / greatest(15.0, log10(any_value(coalesce(alerts, 0)) + 10.0) * 10.0))), 2) AS execution_gap_score
  FROM gaps g LEFT JOIN alert_n USING (entity_id) GROUP BY 1)"""


def event_gaps(spark, sf) -> DataFrame:
    return eg.evaluate_rules(telemetry(spark, sf), EVENTS_PERIOD, rule_registry())


def alert_counts(events: DataFrame) -> DataFrame:
    return of_type(events, "alert_metadata").groupBy("entity_id").agg(F.count("*").alias("alerts"))


@query(
    "r1_gap_subscores",
    with_sql("alerts", "inv", "act", "esc", "inc", extra=EVENT_GAPS, body="SELECT entity_id, gap_count, execution_gap_score FROM gap_score"),
)
def gap_scores(spark, sf):
    return gap_subscores(event_gaps(spark, sf), alert_counts(telemetry(spark, sf)))


SILENT_TELEMETRY = """weekend AS (SELECT entity_id, count(*) AS w FROM alerts WHERE isodow(ts) >= 6 GROUP BY 1),
surge AS (SELECT entity_id, count(*) AS h FROM alerts WHERE severity IN ('CRITICAL', 'HIGH') GROUP BY 1),
absent AS (SELECT entity_id, 80 * 0.95 AS s FROM weekend WHERE w >= 20 UNION ALL SELECT entity_id, 88 * 0.88 FROM surge WHERE h >= 20),
ns_score AS (SELECT entity_id, count(*) AS absence_count, round(least(100.0, sum(s / 100.0 * 20.0)), 2) AS negative_space_score FROM absent GROUP BY 1)"""


def silent_absences(spark, sf) -> DataFrame:
    """Alerts alone: no activity and no escalation is submitted."""
    registry = check_registry()
    for code in ("NS-01", "NS-03", "NS-04", "NS-06", "NS-07", "NS-08"):
        registry.enable(code, False)
    return evaluate_checks(alerts(spark, sf), EVENTS_PERIOD, registry)


@query(
    "r2_absence_subscores",
    with_sql("alerts", extra=SILENT_TELEMETRY, body="SELECT entity_id, negative_space_score, absence_count FROM ns_score"),
)
def ns_scores(spark, sf):
    return absence_subscores(silent_absences(spark, sf))


COMPOSITE = EVENT_GAPS + ",\n" + SILENT_TELEMETRY + """,
merged AS (SELECT e.entity_id, coalesce(gap_count, 0) AS gap_count, coalesce(absence_count, 0) AS absence_count,
  coalesce(execution_gap_score, 0.0) AS execution_gap_score, coalesce(negative_space_score, 0.0) AS negative_space_score, p.peer_deviation_score
  FROM entities e LEFT JOIN gap_score USING (entity_id) LEFT JOIN ns_score USING (entity_id)
  JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, round(avg(c_acctbal) / 100, 2) AS peer_deviation_score FROM customer GROUP BY 1) p USING (entity_id)),
composite AS (SELECT *, round(least(100.0, greatest(0.0, 0.45 * execution_gap_score + 0.35 * negative_space_score + 0.20 * peer_deviation_score)), 2) AS composite_risk_score FROM merged),
tiered AS (SELECT *, CASE WHEN composite_risk_score <= 25 THEN 'LOW' WHEN composite_risk_score <= 50 THEN 'GUARDED' WHEN composite_risk_score <= 75 THEN 'ELEVATED' ELSE 'CRITICAL' END AS risk_tier FROM composite)"""


def composite_scores(spark, sf) -> DataFrame:
    peers = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("entity_id")).agg(
        F.round(F.avg("c_acctbal") / 100, 2).alias("peer_deviation_score")
    )
    return risk_scores(
        entities(spark, sf), alert_counts(telemetry(spark, sf)), event_gaps(spark, sf), silent_absences(spark, sf),
        peers, EVENTS_PERIOD, EVENTS_PERIOD.end,
    )


@query(
    "r4_risk_scores",
    with_sql("entities", "alerts", "inv", "act", "esc", "inc", extra=COMPOSITE, body="""
SELECT entity_id, execution_gap_score, negative_space_score, peer_deviation_score, composite_risk_score, risk_tier, 'STABLE' AS trend_direction,
  'Composite Risk Score: ' || composite_risk_score || '/100 (' || risk_tier || ' Tier). Component breakdown: Execution Gap = ' || execution_gap_score
  || ' (weight 45%), Negative Space = ' || negative_space_score || ' (weight 35%), Peer Deviation = ' || peer_deviation_score || ' (weight 20%).'
  || CASE WHEN execution_gap_score < 50 AND negative_space_score < 50 AND peer_deviation_score < 60 THEN ' Risk indicators remain within nominal supervisory tolerances.'
     ELSE ' Primary risk drivers: ' || concat_ws(', ', CASE WHEN execution_gap_score >= 50 THEN gap_count || ' execution gaps detected' END,
       CASE WHEN negative_space_score >= 50 THEN absence_count || ' negative space absence anomalies detected' END,
       CASE WHEN peer_deviation_score >= 60 THEN 'statistically significant negative deviation from sector peer cohort' END) || '.' END AS rationale_summary
FROM tiered"""),
)
def scores(spark, sf):
    return composite_scores(spark, sf).select(
        "entity_id", "execution_gap_score", "negative_space_score", "peer_deviation_score",
        "composite_risk_score", "risk_tier", "trend_direction", "rationale_summary",
    )
