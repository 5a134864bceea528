"""Queries for Merkle trees, manifests and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.catalog.families import EVENTS_PERIOD, alerts, cases, entities, table, tag, with_sql
from vigil.catalog.ingest_queries import NOW, RAW, raw_rows, staging
from vigil.catalog.peer_queries import peer_events
from vigil.catalog.registry import query
from vigil.catalog.view_queries import SCORES, score_history, submissions
from vigil.operators import evaluation as ev
from vigil.operators.manifest import COMPONENTS, build_manifests, event_leaves, latest_manifests, verify_manifests
from vigil.operators.merkle import composite_root, merkle_roots
from vigil.operators.views import page
from vigil.operators.validation import quarantine_summary, quarantined_rows, validate
from vigil.plans.analyze import analyze, persist_run, run_counts
from vigil.sources.readers import read_events
from vigil.sources.sinks import QUARANTINE, append_events, append_quarantine, dump_quarantine, replace_by_entity, write_manifests
from vigil.sources.snapshots import read_table

# recursion over lists: each step sorts the digests and hashes neighbours
TREE = """tree AS (SELECT k, list(lower(h)) AS l FROM leaf GROUP BY k
  UNION ALL SELECT k, list_transform(range(0, CAST(ceil(len(l) / 2.0) AS BIGINT)),
    lambda i: sha256(list_sort(l)[2 * i + 1] || coalesce(list_sort(l)[2 * i + 2], list_sort(l)[2 * i + 1]))) FROM tree WHERE len(l) > 1),
roots AS (SELECT k, l[1] AS root FROM tree WHERE len(l) = 1)"""


def tree_sql(leaf: str, body: str, *names: str, extra: str = "") -> str:
    parts = ([extra] if extra else []) + [f"leaf AS ({leaf})", TREE]
    return with_sql(*names, extra=",\n".join(parts), body=body, recursive=True)


@query(
    "m2_merkle_roots",
    tree_sql("SELECT source AS k, sha256(text) AS h FROM documents", "SELECT k AS source, root, (SELECT count(*) FROM leaf WHERE leaf.k = roots.k) AS leaf_count FROM roots"),
)
def document_roots(spark, sf):
    leaves = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("digest"))
    return merkle_roots(leaves, ["source"])


@query(
    "m2_merkle_roots_distributed",
    tree_sql("SELECT lang AS k, sha256(text) AS h FROM documents", "SELECT k AS lang, root, (SELECT count(*) FROM leaf WHERE leaf.k = roots.k) AS leaf_count FROM roots"),
)
def document_roots_distributed(spark, sf):
    """The level-by-level path meant for large trees."""
    leaves = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("digest"))
    return merkle_roots(leaves, ["lang"], tail=64)


@query(
    "m7_merkle_sorted_once",
    """WITH RECURSIVE leaf AS (SELECT source AS k, sha256(text) AS h FROM documents),
tree AS (SELECT k, list_sort(list(h)) AS l FROM leaf GROUP BY k
  UNION ALL SELECT k, list_transform(range(0, CAST(ceil(len(l) / 2.0) AS BIGINT)),
    lambda i: sha256(unhex(l[2 * i + 1]) || unhex(coalesce(l[2 * i + 2], l[2 * i + 1])))) FROM tree WHERE len(l) > 1)
SELECT k AS source, l[1] AS root FROM tree WHERE len(l) = 1""",
)
def document_roots_once(spark, sf):
    leaves = table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("digest"))
    return merkle_roots(leaves, ["source"], tail=16, mode="sorted_once").select("source", "root")


@query(
    "m3_composite_root",
    "SELECT page_id, sha256(array_to_string(list_sort([sha256(url), sha256(html), sha256(CAST(page_id AS VARCHAR)), sha256('')]), '')) AS root FROM pages",
)
def composites(spark, sf):
    parts = [F.sha2(c, 256) for c in (F.col("url"), F.col("html"), F.col("page_id").cast("string"), F.lit(""))]
    return table(spark, sf, "pages").select("page_id", composite_root(*parts).alias("root"))


#: The documents below write all times with microseconds, also those of whole seconds.
TIMESPEC = "microseconds"
EVENT_DOC = """'{"action":"error","asset_id":"' || asset_id || '","dataset_type":"alert_metadata","event_id":"' || event_id || '","event_timestamp":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","normalized_payload":{},"raw_ref_id":"' || ref || '","severity":"' || severity
  || '","standard_event_type":"ALERT","status":null,"submission_id":null}'"""


@query("m1_event_leaves", with_sql("alerts", body=f"SELECT entity_id, sha256({EVENT_DOC}) AS digest FROM alerts"))
def leaves(spark, sf):
    return event_leaves(alerts(spark, sf), TIMESPEC).select("entity_id", "digest")


def score_table(spark, sf) -> DataFrame:
    start = F.lit(EVENTS_PERIOD.start).cast("timestamp")
    return score_history(spark, sf).withColumn("period_start", start).withColumn("period_end", start)


SEAL_PERIOD = EVENTS_PERIOD
SUBMISSION_DOC = """'{"file_name":"' || source || '_' || doc_id || '","minio_path":"/in/' || source || '","row_count":' || n_chars || ',"sha256_hash":"' || sha256(text) || '","submission_id":"F' || doc_id || '"}'"""
SEALED = f"""leaf AS (
  SELECT entity_id || '|e' AS k, sha256({EVENT_DOC}) AS h FROM alerts
  UNION ALL SELECT CAST(doc_id % 25 AS VARCHAR) || '|s', sha256({SUBMISSION_DOC}) FROM documents),
{TREE},
sealed AS (SELECT entity_id, entity_code,
  coalesce((SELECT root FROM roots WHERE k = entity_id || '|s'), sha256('')) AS s, coalesce((SELECT root FROM roots WHERE k = entity_id || '|e'), sha256('')) AS e,
  (SELECT count(*) FROM leaf WHERE k = entity_id || '|s') AS file_count, (SELECT count(*) FROM leaf WHERE k = entity_id || '|e') AS event_count FROM entities)"""


def sealed_tables(spark, sf) -> dict[str, DataFrame]:
    return {"submissions": submissions(spark, sf), "events": alerts(spark, sf)}


def seal(spark, sf) -> DataFrame:
    return build_manifests(entities(spark, sf), sealed_tables(spark, sf), SEAL_PERIOD, NOW, timespec=TIMESPEC)


@query(
    "m4_manifests",
    with_sql("entities", "alerts", extra=SEALED, recursive=True, body="""SELECT entity_id, entity_code, s AS submissions_root, e AS events_root,
  sha256(array_to_string(list_sort([s, e, sha256(''), sha256('')]), '')) AS root_merkle_sha256, file_count, event_count FROM sealed"""),
)
def manifests(spark, sf):
    return seal(spark, sf).select(
        "entity_id", "entity_code", F.col(f"component_hashes.{COMPONENTS[0]}").alias("submissions_root"),
        F.col(f"component_hashes.{COMPONENTS[2]}").alias("events_root"), "root_merkle_sha256", "file_count", "event_count",
    )


@query(
    "m5_verification",
    with_sql("entities", "alerts", body="""SELECT entity_id, NOT EXISTS (SELECT 1 FROM alerts a WHERE a.entity_id = e.entity_id AND severity = 'LOW') AS is_valid,
  CASE WHEN EXISTS (SELECT 1 FROM alerts a WHERE a.entity_id = e.entity_id AND severity = 'LOW') THEN 'TAMPER_DETECTED' ELSE 'VERIFIED' END AS status,
  CAST(CASE WHEN EXISTS (SELECT 1 FROM alerts a WHERE a.entity_id = e.entity_id AND severity = 'LOW') THEN 2 ELSE 0 END AS BIGINT) AS discrepancies FROM entities e"""),
)
def verification(spark, sf):
    """Low alerts are relabelled after sealing; entities without one still verify."""
    stored = seal(spark, sf)
    changed = sealed_tables(spark, sf)
    changed["events"] = changed["events"].withColumn(
        "severity", F.when(F.col("severity") == "LOW", "HIGH").otherwise(F.col("severity"))
    )
    return verify_manifests(stored, entities(spark, sf), changed, SEAL_PERIOD, timespec=TIMESPEC).select(
        "entity_id", "is_valid", "status", F.size("discrepancies").cast("bigint").alias("discrepancies")
    )


@query(
    "m6_manifest_lookup",
    "SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, '2024-03-02' AS generated FROM nation ORDER BY entity_id LIMIT 10",
)
def lookup(spark, sf):
    both = seal(spark, sf)
    later = both.withColumn("generated_at", F.expr("generated_at + INTERVAL 1 DAY"))
    newest = latest_manifests(both.unionByName(later))
    return page(newest, "entity_id", limit=10).select(
        "entity_id", F.date_format("generated_at", "yyyy-MM-dd").alias("generated")
    )


# --- evaluation -----------------------------------------------------------------------------------
# truth: one anomaly per document label and per toxic document; findings name documents of one
# quality class, so matches, misses and false positives all occur


def planted(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels")
    return labels.select(
        tag("Q", "quality").alias("code"), tag("G", "doc_id").alias("truth_id"), F.col("doc_id").alias("truth_order"),
        F.array(tag("D", "doc_id")).alias("evidence_ids"),
    )


def detected(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    code = F.when(F.col("n_chars") >= 400, "Q1").otherwise("Q0")
    return docs.select(
        code.alias("code"), tag("F", "doc_id").alias("finding_id"),
        F.when(F.col("lang") != "en", F.array(tag("D", "doc_id"))).otherwise(F.array().cast("array<string>")).alias("refs"),
        F.when(F.col("lang") == "en", F.concat(F.lit("see ("), tag("D", "doc_id"), F.lit(")."))).otherwise("").alias("text"),
    )


MATCHED = """found AS (SELECT CASE WHEN n_chars >= 400 THEN 'Q1' ELSE 'Q0' END AS code, doc_id FROM documents),
planted AS (SELECT 'Q' || quality AS code, doc_id FROM labels),
hit AS (SELECT code, doc_id FROM found JOIN planted USING (code, doc_id)),
sized AS (SELECT c.code, (SELECT count(*) FROM found f WHERE f.code = c.code) AS nf, (SELECT count(*) FROM planted p WHERE p.code = c.code) AS np,
  (SELECT count(*) FROM hit h WHERE h.code = c.code) AS nh FROM (VALUES ('Q0'), ('Q1'), ('Q2')) c(code)),
counts AS (SELECT code, nf, np, CASE WHEN np = 0 THEN nf WHEN nh = 0 THEN least(np, nf) ELSE nh END AS tp FROM sized),
rated AS (SELECT *, CASE WHEN nf > 0 THEN tp / nf * 100.0 ELSE 100.0 END AS p, CASE WHEN np > 0 THEN tp / np * 100.0 ELSE 100.0 END AS r FROM counts),
scored_rules AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 100.0 END AS f1 FROM rated)"""


@query(
    "e1_finding_matches",
    f"WITH {MATCHED} SELECT code, 'F' || doc_id AS det, 'G' || doc_id AS gt FROM hit",
)
def matches(spark, sf):
    return ev.match_findings(detected(spark, sf), planted(spark, sf)).select("code", "det", "gt")


def per_rule(spark, sf) -> DataFrame:
    rules = spark.createDataFrame([("Q0",), ("Q1",), ("Q2",)], "code string")
    d, t = detected(spark, sf), planted(spark, sf)
    return ev.rule_metrics(rules, d, t, ev.match_findings(d, t))


@query(
    "e2_rule_metrics",
    f"""WITH {MATCHED} SELECT code, np AS ground_truth_count, tp, nf - tp AS fp, np - tp AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1,
  CASE WHEN f1 >= 90 THEN 'PASS (>=90%)' ELSE 'REVIEW' END AS status_badge FROM scored_rules""",
)
def rule_quality(spark, sf):
    df = per_rule(spark, sf)
    for c in ("precision", "recall", "f1"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "e2_macro_metrics",
    f"""WITH {MATCHED}, m AS (SELECT avg(p) AS p, avg(r) AS r, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(nf - tp) AS BIGINT) AS fp, CAST(sum(np - tp) AS BIGINT) AS fn FROM scored_rules)
SELECT round(p, 4) AS macro_precision, round(r, 4) AS macro_recall, tp, fp, fn, round(2 * p * r / (p + r), 4) AS macro_f1 FROM m""",
)
def macro(spark, sf):
    df = ev.macro_metrics(per_rule(spark, sf))
    for c in ("macro_precision", "macro_recall", "macro_f1"):
        df = df.withColumn(c, F.round(c, 4))
    return df


# every order's score against the band of its nation's size tier
BANDED = f"""{SCORES}, banded AS (SELECT s.*, CASE size_tier WHEN 'Tier-1' THEN 'healthy' WHEN 'Tier-2' THEN 'average' ELSE 'weak' END AS true_tier,
  CASE size_tier WHEN 'Tier-1' THEN 0.0 WHEN 'Tier-2' THEN 35.0 ELSE 75.0 END AS lo, CASE size_tier WHEN 'Tier-1' THEN 25.0 WHEN 'Tier-2' THEN 65.0 ELSE 100.0 END AS hi,
  CASE WHEN composite <= 30 THEN 'healthy' WHEN composite <= 70 THEN 'average' ELSE 'weak' END AS predicted FROM scores s JOIN entities USING (entity_id))"""


def banded(spark, sf) -> DataFrame:
    return ev.scored_bands(score_history(spark, sf), ev.expected_bands(entities(spark, sf), "size_tier"))


@query(
    "e3_confusion_matrix",
    with_sql("entities", extra=BANDED, body="""SELECT true_tier, count(*) FILTER (WHERE predicted = 'healthy') AS healthy,
  count(*) FILTER (WHERE predicted = 'average') AS average, count(*) FILTER (WHERE predicted = 'weak') AS weak FROM banded GROUP BY 1"""),
)
def confusion(spark, sf):
    return ev.confusion_matrix(banded(spark, sf))


@query(
    "e4_score_errors",
    with_sql("entities", extra=BANDED, body="""SELECT count(*) AS entities, round(avg(abs(composite - (lo + hi) / 2)), 4) AS mae,
  round(sqrt(avg(pow(composite - (lo + hi) / 2, 2))), 4) AS rmse, round(count(*) FILTER (WHERE composite >= lo AND composite <= hi) / count(*) * 100.0, 4) AS band_compliance,
  round(count(*) FILTER (WHERE true_tier = predicted) / count(*) * 100.0, 4) AS tier_accuracy FROM banded"""),
)
def score_errors(spark, sf):
    df = ev.score_errors(banded(spark, sf))
    for c in ("mae", "rmse", "band_compliance", "tier_accuracy"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "e5_gate",
    with_sql("entities", extra=BANDED + ",\n" + MATCHED, body="""SELECT (2 * p * r / (p + r)) >= 20 AND accuracy >= 30 AS passed FROM (SELECT avg(p) AS p, avg(r) AS r FROM scored_rules),
  (SELECT count(*) FILTER (WHERE true_tier = predicted) / count(*) * 100.0 AS accuracy FROM banded)"""),
)
def gate(spark, sf):
    return ev.gate(ev.macro_metrics(per_rule(spark, sf)), ev.score_errors(banded(spark, sf)), 20.0, 0.3).select("passed")


# --- full runs and stored tables ------------------------------------------------------------------


@query("r8_full_run")
def full_run(spark, sf):
    """All engines over alerts, investigations, activity, escalations, incidents, cases, assets and notes."""
    run = analyze(peer_events(spark, sf), entities(spark, sf), EVENTS_PERIOD)
    path = staging(spark, "run")
    persist_run(run, path)
    return run_counts(run)


@query(
    "s15_stored_events",
    with_sql("alerts", body="SELECT entity_id, 'alert_metadata' AS dataset_type, count(*) AS rows, count(DISTINCT event_id) AS events FROM alerts GROUP BY 1"),
)
def stored(spark, sf):
    path = staging(spark, "events")
    append_events(alerts(spark, sf), path)
    append_events(alerts(spark, sf).limit(0), path)
    back = read_events(spark, path)
    return back.groupBy("entity_id", "dataset_type").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"))


@query(
    "s14_entity_events",
    with_sql("alerts", body="SELECT event_id, row_number() OVER (ORDER BY ts, n, event_id) AS position FROM alerts WHERE entity_id = '7'"),
)
def entity_scan(spark, sf):
    """Stored events of one entity in time order."""
    path = staging(spark, "scan")
    append_events(alerts(spark, sf), path)
    scan = read_events(spark, path, "7", ("alert_metadata",), ordered=True)
    order = W.partitionBy(F.to_date("event_timestamp")).orderBy("event_timestamp", "raw_row_index", "event_id")
    days = scan.groupBy(F.to_date("event_timestamp").alias("day")).agg(F.count("*").alias("n"))
    before = days.withColumn(
        "before", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )  # one row per day
    return scan.select("event_id", F.to_date("event_timestamp").alias("day"), F.row_number().over(order).alias("r")).join(
        before, "day"
    ).select("event_id", (F.col("before") + F.col("r")).alias("position"))


@query(
    "s18_replaced_findings",
    with_sql("cases", body="""SELECT entity_id, count(*) FILTER (WHERE status = 'CLOSED') AS closed_findings, count(*) FILTER (WHERE status <> 'CLOSED') AS other_findings
FROM cases WHERE entity_id NOT IN ('4', '5', '6') GROUP BY 1"""),
)
def replaced(spark, sf):
    """A rerun replaces an entity's rows: entities 4 to 6 have none any more, and the run did not look at entity 3."""
    path = staging(spark, "findings")
    rows = cases(spark, sf).select("entity_id", "event_id", "status")
    stale = rows.withColumn("status", F.when(F.col("entity_id") == "3", F.col("status")).otherwise("STALE"))
    replace_by_entity(stale, path, "findings")
    seen = rows.where("entity_id != '3'")
    replace_by_entity(seen.where("entity_id NOT IN ('4', '5', '6')"), path, "findings", seen.select("entity_id").distinct())
    back = read_table(spark, path, "findings", "event_id string, status string, entity_id string")
    return back.groupBy("entity_id").agg(
        F.count_if(F.col("status") == "CLOSED").alias("closed_findings"), F.count_if(F.col("status") != "CLOSED").alias("other_findings")
    )


@query(
    "s17_quarantine_dump",
    f"""WITH {RAW} SELECT 'row' AS kind, entity_id, 'S' || entity_id AS submission_id, event_id AS row_index, failure_reason AS label, 1 AS rows FROM quarantine
UNION ALL SELECT 'reason', entity_id, 'S' || entity_id, NULL, code, count(*) FROM quarantine GROUP BY entity_id, code
UNION ALL SELECT 'field', entity_id, 'S' || entity_id, NULL, failed_field, count(*) FROM quarantine GROUP BY entity_id, failed_field""",
)
def dump(spark, sf):
    """The rows and the summary of the JSON dump, read back; a second dump replaces the first."""
    path = staging(spark, "dump")
    bad = quarantined_rows(validate(raw_rows(spark, sf)), NOW)
    for _ in range(2):
        dump_quarantine(bad, quarantine_summary(bad), path)
    rows = spark.read.schema("entity_id string, submission_id string, row_index long, failure_reason string").json(f"{path}/rows")
    summary = spark.read.schema("entity_id string, submission_id string, kind string, label string, rows long").json(f"{path}/summary")
    return rows.select(
        F.lit("row").alias("kind"), "entity_id", "submission_id", "row_index", F.col("failure_reason").alias("label"), F.lit(1).cast("long").alias("rows"),
    ).unionByName(summary.withColumn("row_index", F.lit(None).cast("long")))


@query(
    "s16_stored_quarantine",
    f"WITH {RAW} SELECT entity_id, event_id AS row_index, failure_reason, failed_field FROM quarantine",
)
def quarantine_table(spark, sf):
    path = staging(spark, "quarantine")
    append_quarantine(quarantined_rows(validate(raw_rows(spark, sf)), NOW), path)
    back = read_table(spark, path, QUARANTINE, "entity_id string, row_index long, failure_reason string, failed_fields array<string>")
    return back.select("entity_id", "row_index", "failure_reason", F.array_join("failed_fields", ",").alias("failed_field"))


@query("s19_manifest_documents", "SELECT n_nationkey AS entity_id, '2024' AS year, '03' AS month FROM nation")
def manifest_documents(spark, sf):
    path = staging(spark, "manifests")
    write_manifests(seal(spark, sf), path)
    back = spark.read.json(path).select("entity_id", "year", "month")
    return back.select(F.col("entity_id").cast("int").alias("entity_id"), F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"))
