"""Queries for reading, validation, mapping and the scalar functions.

Rows come from the events, lineitem and documents tables: as maps, as delimited or JSON text, or as
files written to the shared staging folder and read back.
"""

from __future__ import annotations

import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.catalog.families import entities, table, tag, with_sql
from vigil.catalog.registry import query
from vigil.functions.canonical import json_map, sha256
from vigil.functions.scalars import cast_boolean, clean_key, normalize_severity, normalize_status, risk_tier, severity_of_score
from vigil.functions.timestamps import parse_iso, parse_timestamp
from vigil.operators.mapping import Profile, active_profiles, normalize, profile_table, renamed, with_defaults
from vigil.operators.validation import (
    evaluation_skips,
    quarantine_summary,
    quarantined_rows,
    submission_status,
    valid_rows,
    validate,
)
from vigil.plans.ingest import ingest_rows
from vigil.session import ensure_checkpoint_dir, spread
from vigil.sources.formats import classify_dataset, detect_delimiter, header_tokens
from vigil.sources.readers import clean_value, file_digests, match_entities, read_ground_truth, read_submissions, read_tree

NOW = datetime(2024, 3, 1)


def staging(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can read and write."""
    return f"{ensure_checkpoint_dir(spark)}/staging-{uuid.uuid4().hex}/{name}"


def _entity() -> Column:
    return (F.col("user_id") % 25).cast("string")


# --- raw rows of the events table -----------------------------------------------------------------
# defects by value: below 2 the time is missing, below 4 the id, below 6 the time is not a time,
# below 8 the duration is not a number, below 10 the parser flagged the row; the others are sound but
# share their id with the event before when the value is 90 or more


def raw_rows(spark, sf) -> DataFrame:
    v = F.col("value")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.when(v >= 90, F.col("event_id") - 1).otherwise(F.col("event_id"))
    data = F.create_map(
        F.lit("alert_id"), F.when((v < 2) | (v >= 4), tag("A", "k")),
        F.lit("Event-Time"), F.lit(None).cast("string"),
        F.lit("timestamp"), F.when((v >= 4) & (v < 6), "INVALID_DATE").when(v >= 2, F.col("stamp")),
        F.lit("RiskLevel"), F.when(v >= 70, "fatal").when(v >= 35, "P2").when(v >= 15, "odd").otherwise("1"),
        F.lit("duration_seconds"), F.when((v >= 6) & (v < 8), "many").otherwise(v.cast("string")),
        F.lit("TargetHost"), tag("H", "user_id"),
        F.lit("Signature_Name"), F.col("event_type"),
        F.lit("State"), F.concat(F.lit(" "), F.lower("event_type")),
        F.lit("k"), F.get_json_object("props", "$.k"),
    )
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    rows = spread(events, events.count())
    return (
        rows.withColumn("k", key).withColumn("stamp", stamp).select(
            F.concat(F.lit("S"), _entity()).alias("submission_id"),
            _entity().alias("entity_id"),
            F.lit("alert_metadata").alias("dataset_type"),
            F.col("event_id").alias("row_index"),
            data.alias("data"),
            ((v >= 8) & (v < 10)).alias("is_corrupted"),
            F.when((v >= 8) & (v < 10), "Column count mismatch: expected 9, got 8").alias("corruption_reason"),
            F.lit(None).cast("string").alias("raw_text"),
        )
    )


RAW = """raw AS (SELECT *, CAST(user_id % 25 AS VARCHAR) AS entity_id, 'A' || (CASE WHEN value >= 90 THEN event_id - 1 ELSE event_id END) AS key,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events),
checked AS (SELECT *, CASE WHEN value >= 8 AND value < 10 THEN 'CORRUPTED_ROW'
    WHEN value >= 2 AND value < 4 THEN 'MISSING_REQUIRED_FIELD' WHEN value < 2 THEN 'MISSING_REQUIRED_FIELD'
    WHEN value >= 4 AND value < 6 THEN 'DATETIME_PARSE_ERROR' WHEN value >= 6 AND value < 8 THEN 'TYPE_MISMATCH' END AS first_code FROM raw),
ranked AS (SELECT *, CASE WHEN first_code IS NULL THEN row_number() OVER (PARTITION BY entity_id, key, first_code IS NULL ORDER BY event_id) END AS r FROM checked),
judged AS (SELECT *, CASE WHEN first_code IS NULL AND r > 1 THEN 'DUPLICATE_PRIMARY_KEY' ELSE first_code END AS code FROM ranked),
quarantine AS (SELECT entity_id, event_id, '[' || code || '] ' || CASE code
    WHEN 'CORRUPTED_ROW' THEN 'Column count mismatch: expected 9, got 8'
    WHEN 'MISSING_REQUIRED_FIELD' THEN 'Missing mandatory field from candidate group: ' || CASE WHEN value < 2
      THEN '[''timestamp'', ''event_time'', ''EventTime_UTC'', ''time'', ''created_at'', ''@timestamp'']'
      ELSE '[''alert_id'', ''id'', ''Incident_ID'', ''alertId'', ''event_id'', ''alert_uid'']' END
    WHEN 'DATETIME_PARSE_ERROR' THEN 'Unable to parse timestamp ''INVALID_DATE'' in field ''timestamp'''
    WHEN 'TYPE_MISMATCH' THEN 'Field ''duration_seconds'' with value ''many'' cannot be converted to number'
    ELSE 'Duplicate primary key ''' || key || ''' encountered in batch' END AS failure_reason,
  CASE code WHEN 'CORRUPTED_ROW' THEN '__raw__' WHEN 'MISSING_REQUIRED_FIELD' THEN CASE WHEN value < 2 THEN 'timestamp' ELSE 'alert_id' END
    WHEN 'DATETIME_PARSE_ERROR' THEN 'timestamp' WHEN 'TYPE_MISMATCH' THEN 'duration_seconds' ELSE 'primary_key' END AS failed_field, code
  FROM judged WHERE code IS NOT NULL)"""


@query("v1_v6_quarantined_rows", f"WITH {RAW} SELECT entity_id, event_id AS row_index, failure_reason, failed_field FROM quarantine")
def quarantine(spark, sf):
    return quarantined_rows(validate(raw_rows(spark, sf)), NOW).select(
        "entity_id", "row_index", "failure_reason", F.array_join("failed_fields", ",").alias("failed_field")
    )


@query("v7_valid_rows", f"WITH {RAW} SELECT entity_id, event_id AS row_index FROM judged WHERE code IS NULL")
def sound_rows(spark, sf):
    return valid_rows(validate(raw_rows(spark, sf))).select("entity_id", "row_index")


@query(
    "v8_submission_status",
    f"""WITH {RAW} SELECT entity_id, count(*) AS row_count, count(*) FILTER (WHERE code IS NULL) AS valid_row_count,
  count(*) FILTER (WHERE code IS NOT NULL) AS quarantined_row_count, 'PARTIAL_SUCCESS' AS ingestion_status,
  count(*) FILTER (WHERE code IS NOT NULL) || ' rows quarantined due to validation errors' AS error_summary FROM judged GROUP BY 1
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 0, 0, 0, 'FAILED', 'No rows found in input data' FROM nation
WHERE n_nationkey NOT IN (SELECT user_id % 25 FROM events)""",
)
def status(spark, sf):
    batches = entities(spark, sf).select("entity_id", F.concat(F.lit("S"), "entity_id").alias("submission_id"))
    return submission_status(validate(raw_rows(spark, sf)), batches).drop("submission_id")


@query(
    "v10_quarantine_summary",
    f"""WITH {RAW} SELECT entity_id, 'reason' AS kind, code AS label, count(*) AS rows FROM quarantine GROUP BY 1, 3
UNION ALL SELECT entity_id, 'field', failed_field, count(*) FROM quarantine GROUP BY 1, 3""",
)
def summary(spark, sf):
    return quarantine_summary(quarantined_rows(validate(raw_rows(spark, sf)), NOW)).drop("submission_id")


@query("v11_evaluation_skips", f"WITH {RAW} SELECT entity_id, count(*) AS kept FROM raw WHERE NOT (value >= 2 AND value < 4) GROUP BY 1")
def skips(spark, sf):
    return evaluation_skips(raw_rows(spark, sf)).groupBy("entity_id").agg(F.count("*").alias("kept"))


NORMAL = """CASE WHEN value >= 70 THEN 'CRITICAL' WHEN value >= 35 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'INFORMATIONAL' END"""


def event_view(events: DataFrame) -> DataFrame:
    return events.select(
        "entity_id", "raw_row_index", "raw_ref_id", "standard_event_type",
        F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
        "asset_id", "action", "status", "severity", F.col("normalized_payload")["k"].alias("k"),
        F.col("normalized_payload")["_row_index"].alias("payload_row"),
    )


@query(
    "p4_normalized_events",
    f"""WITH {RAW} SELECT entity_id, event_id AS raw_row_index, key AS raw_ref_id, 'ALERT' AS standard_event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, 'H' || user_id AS asset_id, event_type AS action, upper(event_type) AS status, {NORMAL} AS severity,
  json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS payload_row FROM judged WHERE code IS NULL""",
)
def normalized(spark, sf):
    return event_view(normalize(valid_rows(validate(raw_rows(spark, sf))), NOW))


@query(
    "p11_ad_hoc_normalization",
    f"""WITH {RAW} SELECT entity_id, event_id AS raw_row_index, CASE WHEN value < 2 OR value >= 4 THEN key END AS raw_ref_id, 'ALERT' AS standard_event_type,
  CASE WHEN value < 2 OR (value >= 4 AND value < 6) THEN '2024-03-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time, 'H' || user_id AS asset_id,
  event_type AS action, upper(event_type) AS status, {NORMAL} AS severity, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS payload_row FROM raw""",
)
def ad_hoc(spark, sf):
    return event_view(normalize(raw_rows(spark, sf), NOW))


def sector_profiles(spark) -> DataFrame:
    """A vendor profile for entity 7 in two versions, and one that is switched off."""
    return profile_table(spark, [
        Profile("7", "alert_metadata", {"k": "rule_id"}, version=1),
        Profile(
            "7", "alert_metadata", {"k": "rule_id", "action": "Signature_Name", "severity": "RiskLevel"},
            defaults={"owner": "desk"}, severity_map={"Fatal": "high", "P2": "low"}, severity_default="LOW", version=2,
        ),
        Profile("8", "alert_metadata", {"k": "rule_id"}, version=3, is_active=False),
    ])


@query(
    "p1_profile_mapping",
    f"""WITH {RAW} SELECT entity_id, event_id AS raw_row_index, event_type AS action,
  CASE WHEN entity_id = '7' THEN CASE WHEN value >= 70 THEN 'HIGH' WHEN value >= 15 THEN 'LOW' ELSE 'INFORMATIONAL' END ELSE {NORMAL} END AS severity,
  CASE WHEN entity_id = '7' THEN json_extract_string(props, '$.k') END AS rule_id, CASE WHEN entity_id = '7' THEN 'desk' END AS owner FROM raw""",
)
def profile_mapping(spark, sf):
    return normalize(raw_rows(spark, sf), NOW, sector_profiles(spark)).select(
        "entity_id", "raw_row_index", "action", "severity", "rule_id", "owner"
    )


@query(
    "p9_active_profiles",
    "SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, r_name AS defaults_sector, n_nationkey AS version FROM nation JOIN region ON r_regionkey = n_regionkey "
    "WHERE (r_name, n_nationkey) IN (SELECT (r_name, max(n_nationkey)) FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)",
)
def newest_profiles(spark, sf):
    e = entities(spark, sf)
    versions = e.select(
        F.col("sector").alias("entity_id"), F.lit("alert_metadata").alias("dataset_type"),
        F.create_map(F.lit("sector"), F.col("sector")).alias("defaults"), F.col("entity_id").alias("nation"),
        F.col("entity_id").cast("int").alias("version"), F.lit(True).alias("is_active"),
    )
    return active_profiles(versions).select(
        F.col("nation").alias("entity_id"), F.col("defaults")["sector"].alias("defaults_sector"), "version"
    )


@query(
    "p3_profile_defaults",
    "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'open' END AS scheme, url AS link FROM pages",
)
def defaults(spark, sf):
    data = F.create_map(
        F.lit("scheme"), F.when(F.startswith("url", F.lit("https")), "secure"), F.lit("link"), F.col("url")
    )
    filled = with_defaults(data, F.create_map(F.lit("scheme"), F.lit("open"), F.lit("link"), F.lit("none")))
    mapped = renamed(filled, F.create_map(F.lit("scheme"), F.lit("kind")))
    return table(spark, sf, "pages").select("page_id", mapped["kind"].alias("scheme"), filled["link"].alias("link"))


# --- files ----------------------------------------------------------------------------------------


def _text_columns(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        tag("A", "event_id").alias("alert_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("value") >= 15, F.col("value").cast("string")).otherwise("N/A").alias("severity"),
        F.concat(F.lit('say "'), F.col("event_type"), F.lit('", twice')).alias("note"),
        tag("H", "user_id").alias("asset_id"),
        "event_type",
    )


def write_lines(lines: DataFrame, first: str, path: str) -> None:
    """Text files of lines (column value), a file for each task, each with the same first line."""
    spark = lines.sparkSession
    files = spark.sparkContext.defaultParallelism
    dealt = lines.select("value", F.lit(1).alias("order"), (F.rand(1) * files).cast("int").alias("part"))
    heads = spark.range(files).select(F.lit(first).alias("value"), F.lit(0).alias("order"), F.col("id").cast("int").alias("part"))
    heads.union(dealt).repartitionById(files, "part").sortWithinPartitions("order").select("value").write.text(path)


FILE_ROWS = """rows_ AS (SELECT 'A' || event_id AS alert_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp",
  CASE WHEN value >= 15 THEN CAST(value AS VARCHAR) END AS severity, 'say "' || event_type || '", twice' AS note, 'H' || user_id AS asset_id, event_type FROM events)"""
FILE_COLUMNS = ("alert_id", "timestamp", "severity", "note", "asset_id")


def unpacked(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select(*[F.col("data")[c].alias(c) for c in FILE_COLUMNS], "is_corrupted", *extra)


@query("s1_delimited_files", f"WITH {FILE_ROWS} SELECT alert_id, \"timestamp\", severity, note, asset_id, FALSE AS is_corrupted FROM rows_")
def delimited(spark, sf):
    path = staging(spark, "csv")
    writer = {"error": ",", "click": ";", "view": "\t", "signup": "|", "purchase": ","}
    rows = _text_columns(spark, sf)
    for kind, separator in writer.items():
        rows.where(F.col("event_type") == kind).drop("event_type").write.option("header", True).option(
            "sep", separator
        ).option("escape", '"').mode("append").csv(path)
    return unpacked(read_submissions(spark, path, "csv"))


@query(
    "s1_row_numbers",
    f"WITH {FILE_ROWS} SELECT count(*) AS rows, count(*) AS numbered, TRUE AS dense FROM rows_",
)
def row_numbers(spark, sf):
    path = staging(spark, "numbers")
    _text_columns(spark, sf).drop("event_type").write.option("header", True).option("escape", '"').csv(path)
    rows = read_submissions(spark, path, "csv")
    per_file = rows.groupBy("file").agg(
        F.count("*").alias("n"), F.count_distinct("row_index").alias("d"), F.max("row_index").alias("last"), F.min("row_index").alias("first")
    )
    return per_file.agg(
        F.sum("n").alias("rows"), F.sum("d").alias("numbered"),
        F.bool_and((F.col("last") == F.col("n")) & (F.col("first") == 1)).alias("dense"),
    )


@query(
    "s1_column_mismatch",
    f"""WITH {FILE_ROWS} SELECT alert_id, CASE WHEN event_type = 'view' THEN 'Column count mismatch: expected 3, got 5'
  WHEN event_type = 'click' THEN 'Column count mismatch: expected 3, got 2' END AS corruption_reason,
  CASE WHEN event_type <> 'click' THEN asset_id END AS asset_id, CASE WHEN event_type = 'view' THEN '["x","y"]' END AS extra FROM rows_""",
)
def mismatch(spark, sf):
    path = staging(spark, "jagged")
    cells = F.when(F.col("event_type") == "view", F.concat_ws(",", "alert_id", "timestamp", "asset_id", F.lit("x"), F.lit("y"))).when(
        F.col("event_type") == "click", F.concat_ws(",", "alert_id", "timestamp")
    ).otherwise(F.concat_ws(",", "alert_id", "timestamp", "asset_id"))
    write_lines(_text_columns(spark, sf).select(cells.alias("value")), "alert_id,timestamp,asset_id", path)
    df = read_submissions(spark, path, "csv")
    return df.select(
        F.col("data")["alert_id"].alias("alert_id"), "corruption_reason",
        F.col("data")["asset_id"].alias("asset_id"), F.col("data")["__extra__"].alias("extra"),
    )


@query(
    "s1_cells_over_lines",
    """SELECT 'D' || doc_id AS id, CASE WHEN lower(trim(text)) NOT IN ('', 'null', 'none', 'n/a', '\\n') THEN sha256(trim(text)) END AS text_sha256,
  FALSE AS is_corrupted FROM documents""",
)
def multiline(spark, sf):
    """Whole texts as quoted cells, with their line breaks."""
    path = staging(spark, "multiline")
    table(spark, sf, "documents").select(tag("D", "doc_id").alias("id"), "text").repartition(8).write.csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_submissions(spark, path, "csv").select(
        F.col("data")["id"].alias("id"), F.sha2(F.col("data")["text"], 256).alias("text_sha256"), "is_corrupted")


@query("s8_encodings", "SELECT 'C' || c_custkey AS id, 'é ' || c_name AS name, FALSE AS is_corrupted FROM customer")
def encodings(spark, sf):
    """Files in ISO-8859-1."""
    path = staging(spark, "latin")
    table(spark, sf, "customer").select(
        tag("C", "c_custkey").alias("id"), F.concat(F.lit("é "), "c_name").alias("name")
    ).write.csv(path, header=True, encoding="ISO-8859-1")
    return read_submissions(spark, path, "csv").select(
        F.col("data")["id"].alias("id"), F.col("data")["name"].alias("name"), "is_corrupted")


@query("s7_json_lines", f"""WITH {FILE_ROWS} SELECT alert_id, "timestamp", severity, note, asset_id, FALSE AS is_corrupted, CAST(NULL AS VARCHAR) AS corruption_reason FROM rows_ WHERE event_type NOT IN ('view', 'click')
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, TRUE, 'NDJSON row is not a JSON object' FROM rows_ WHERE event_type = 'view'
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, TRUE, 'Invalid JSON line syntax' FROM rows_ WHERE event_type = 'click'""")
def json_lines(spark, sf):
    path = staging(spark, "ndjson")
    rows = _text_columns(spark, sf).withColumn("severity", clean_value("severity"))
    good = F.to_json(F.struct(*FILE_COLUMNS))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit('"'), "alert_id", F.lit('"'))).when(
        F.col("event_type") == "click", F.concat(good, F.lit(" trailing"))
    ).otherwise(good)
    # a first line that is an object, as in any file of records
    write_lines(rows.select(line.alias("value")), '{"alert_id":"first"}', path)
    df = read_submissions(spark, path, "json").where(~F.coalesce(F.col("data")["alert_id"] == "first", F.lit(False)))
    return unpacked(df, "corruption_reason")


def _documents(spark, sf, wrapper: str | None) -> str:
    path = staging(spark, wrapper or "array")
    packed = _text_columns(spark, sf).withColumn("severity", clean_value("severity")).groupBy("asset_id").agg(
        F.collect_list(F.struct(*[c for c in FILE_COLUMNS if c != "asset_id"], F.col("asset_id"))).alias("items")
    )
    body = F.to_json("items") if wrapper is None else F.to_json(F.struct(F.lit(1).alias("version"), F.col("items").alias(wrapper)))
    # one document per file
    packed.select("asset_id", body.alias("value")).repartition("asset_id").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


DOCUMENT_SQL = f"WITH {FILE_ROWS} SELECT alert_id, \"timestamp\", severity, note, asset_id, FALSE AS is_corrupted FROM rows_"


@query("s4_json_arrays", DOCUMENT_SQL)
def json_arrays(spark, sf):
    return unpacked(read_submissions(spark, _documents(spark, sf, None), "json"))


@query("s5_json_wrappers", DOCUMENT_SQL)
def json_wrappers(spark, sf):
    return unpacked(read_submissions(spark, _documents(spark, sf, "alerts")))


@query(
    "s6_single_objects",
    "SELECT 'N' || n_nationkey AS id, n_name AS name, FALSE AS is_corrupted, 1 AS row_index FROM nation",
)
def single_objects(spark, sf):
    path = staging(spark, "single")
    nation = table(spark, sf, "nation")
    doc = F.to_json(F.struct(tag("N", "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    nation.select("n_nationkey", doc.alias("value")).write.partitionBy("n_nationkey").text(path)
    return read_submissions(spark, path).select(
        F.col("data")["id"].alias("id"), F.col("data")["name"].alias("name"), "is_corrupted",
        F.col("row_index").cast("int").alias("row_index"),
    )


@query("s12_file_digests", "SELECT sha256(n_name || chr(10)) AS sha256_hash, length(n_name) + 1 AS size FROM nation")
def digests(spark, sf):
    path = staging(spark, "digest")
    table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    return file_digests(spark, f"{path}/*/*.txt").select("sha256_hash", "size")


@query(
    "s2_delimiter",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN ';' ELSE '|' END AS delimiter FROM nation""",
)
def delimiters(spark, sf):
    kind = F.col("n_nationkey") % 4
    d = F.when(kind == 0, ",").when(kind == 1, "\t").when(kind == 2, ";").otherwise("|")
    line = F.concat_ws("", F.lit("a"), d, F.lit('"x, y; z"'), d, F.col("n_name"))
    head = F.array(F.concat_ws("", F.lit("id"), d, F.lit("text"), d, F.lit("name")), line)
    return table(spark, sf, "nation").select("n_nationkey", detect_delimiter(head).alias("delimiter"))


@query(
    "s10_dataset_detection",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'alert_metadata' WHEN 'de' THEN 'case_management' WHEN 'fr' THEN 'asset_inventory' ELSE 'analyst_activity' END AS dataset_type,
  CASE lang WHEN 'en' THEN 126 WHEN 'de' THEN 110 WHEN 'fr' THEN 60 ELSE 70 END AS score,
  CASE lang WHEN 'en' THEN 100 WHEN 'de' THEN 100 WHEN 'fr' THEN 90 ELSE 100 END AS confidence FROM documents""",
)
def detection(spark, sf):
    lang = F.col("lang")
    name = F.when(lang == "en", F.concat(F.lit("alerts_"), "source")).when(lang == "de", F.concat(F.lit("in/02_"), "source")).when(
        lang == "fr", F.lit("part.csv")
    ).otherwise(F.lit("07 analyst_activity.json"))
    head = F.when(lang == "en", F.lit("Alert ID,Rule-Name,source_ip,Severity,timestamp\n1,2,3,4,5")).when(
        lang == "de", F.lit('[{"Case_ID": 1, "priority": "P1"}, {"x": 2}]')
    ).when(lang == "fr", F.lit("id|hostname|owner")).otherwise(F.lit('{"log_id": 7'))
    files = table(spark, sf, "documents").select("doc_id", name.alias("file"), header_tokens(head).alias("tokens"))
    return files.select("doc_id", classify_dataset("file", "tokens").alias("d")).select(
        "doc_id", "d.dataset_type", F.col("d.score").cast("int").alias("score"), F.col("d.confidence").cast("int").alias("confidence")
    )


def _tree(rows: DataFrame, root: str) -> None:
    """Lay out rows (entity_dir, period, kind, id, price) as {entity_dir}/{period}/{kind}/case_management.{kind}."""
    spark = rows.sparkSession
    line = F.when(F.col("kind") == "json", F.to_json(F.struct("id", "price"))).otherwise(F.concat_ws(",", "id", "price"))
    head = rows.where("kind = 'csv'").select("entity_dir", "period", "kind", F.lit("id,price").alias("value"), F.lit(0).alias("order")).distinct()
    lines = head.unionByName(rows.select("entity_dir", "period", "kind", line.alias("value"), F.lit(1).alias("order")))
    parts = ["entity_dir", "period", "kind"]
    lines.repartition(*parts).sortWithinPartitions(*parts, "order").select(*parts, "value").write.partitionBy(*parts).text(f"{root}/parts")
    files = spark._jvm.org.apache.hadoop.fs
    top = files.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(files.Path(f"{root}/parts/*/*/*/*.txt")):
        place = [unquote(x.split("=", 1)[1]) for x in found.getPath().getParent().toString().split("/")[-3:]]
        folder = files.Path(f"{root}/tree/{'/'.join(place)}")
        system.mkdirs(folder)
        system.rename(found.getPath(), files.Path(folder, f"case_management.{place[2]}"))


@query(
    "s20_directory_tree",
    """SELECT r_name AS entity_dir, CAST(year(o_orderdate) AS VARCHAR) AS period, CASE WHEN year(o_orderdate) % 2 = 0 THEN 'json' ELSE 'csv' END AS kind,
  'case_management' AS dataset_type, CAST(o_orderkey AS VARCHAR) AS id, FALSE AS is_corrupted
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name <> 'ASIA'""",
)
def directory_tree(spark, sf):
    """Years with JSON files have CSV files of other rows too, which must be left out; one entity is not asked for."""
    path = staging(spark, "tree")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owners = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    year = F.year("o_orderdate")
    rows = table(spark, sf, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("r_name").alias("entity_dir"), year.cast("string").alias("period"), F.when(year % 2 == 0, "json").otherwise("csv").alias("kind"),
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("price"))
    stale = rows.where("kind = 'json'").withColumn("kind", F.lit("csv")).withColumn("id", F.concat(F.lit("old"), "id"))
    _tree(rows.unionByName(stale), path)
    got = read_tree(spark, f"{path}/tree", F.col("entity_dir") != "ASIA")
    return got.select("entity_dir", "period", "kind", "dataset_type", F.col("data")["id"].alias("id"), "is_corrupted")


@query(
    "s21_ground_truth_files",
    "SELECT 'Q' || quality AS code, 'D' || doc_id || '|' || 'T' || toxic AS evidence FROM labels",
)
def ground_truth(spark, sf):
    path = staging(spark, "truth")
    rows = table(spark, sf, "labels")
    refs = (tag("D", "doc_id"), tag("T", "toxic"))
    as_json = F.to_json(F.struct(tag("Q", "quality").alias("check_id"), F.array(*refs).alias("evidence_ids")))
    rows.where(F.col("toxic") == 0).select(as_json.alias("value")).write.text(f"{path}/json")
    as_csv = rows.where(F.col("toxic") != 0).select(
        tag("Q", "quality").alias("rule_code"), F.concat_ws("; ", *refs).alias("evidence_ids")
    )
    as_csv.write.option("header", True).csv(f"{path}/csv")
    return read_ground_truth(spark, f"{path}/*").select("code", F.array_join("evidence_ids", "|").alias("evidence"))


@query(
    "s22_entity_directories",
    with_sql("entities", extra="""dirs AS (SELECT 'export-' || entity_code || '-' || size_tier AS d FROM entities UNION ALL
  SELECT 'EXPORT ' || lower(replace(name, ' ', '_')) || '.' || sector FROM entities)""", body="""
SELECT d AS entity_dir, arg_min(entity_id, (how, entity_id)) AS entity_id FROM (
  SELECT d, entity_id, 0 AS how FROM dirs JOIN entities ON contains(d, entity_code)
  UNION ALL SELECT d, entity_id, 1 FROM dirs JOIN entities ON contains(lower(d), lower(replace(name, ' ', '_')))) GROUP BY d"""),
)
def directories(spark, sf):
    e = entities(spark, sf)
    by_code = e.select(F.concat_ws("-", F.lit("export"), "entity_code", "size_tier").alias("entity_dir"))
    by_slug = e.select(
        F.concat(F.lit("EXPORT "), F.lower(F.replace("name", F.lit(" "), F.lit("_"))), F.lit("."), "sector").alias("entity_dir")
    )
    return match_entities(by_code.unionByName(by_slug), e)


# --- scalar functions -----------------------------------------------------------------------------

LAYOUTS = (
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", 0), ("yyyy-MM-dd HH:mm:ss", 1), ("dd/MM/yyyy HH:mm:ss", 2),
    ("yyyy/MM/dd HH:mm:ss", 3), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", 4), ("dd-MM-yyyy HH:mm:ss", 5),
)


@query(
    "x1_parse_timestamp",
    """SELECT event_id, strftime(CASE WHEN event_id % 8 = 7 THEN NULL ELSE date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""",
)
def parsed_times(spark, sf):
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 8
    text = F.when(kind == 6, F.unix_seconds(ts).cast("string")).when(kind == 7, F.lit("not a time"))
    for layout, k in LAYOUTS:
        # Spark does not format day names, so they are spelled from the weekday
        if layout.startswith("EEE"):
            day = F.element_at(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), F.weekday(ts) + 1)
            shown = F.concat(day, F.lit(", "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
        else:
            shown = F.date_format(ts, layout)
        text = text.when(kind == k, shown)
    return table(spark, sf, "events").select(
        "event_id", F.date_format(parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query(
    "x3_parse_iso",
    """SELECT event_id, strftime(CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN ts - INTERVAL 2 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events""",
)
def parsed_iso(spark, sf):
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    text = F.when(kind == "view", F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm:ss")).when(
        kind == "error", F.concat(ts, F.lit("+02:00"))
    ).otherwise(F.concat(ts, F.lit("Z")))
    return table(spark, sf, "events").select(
        "event_id", F.date_format(parse_iso(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed")
    )


@query(
    "x4_normalize_severity",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
  WHEN '5-LOW' THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity, CASE o_orderpriority WHEN '2-HIGH' THEN 'LOW' WHEN '5-LOW' THEN 'LOW' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'HIGH' END AS custom FROM orders""",
)
def severities(spark, sf):
    word = F.regexp_replace("o_orderpriority", r"^\d-", "")
    raw = F.when(word == "URGENT", " Fatal").when(word == "NOT SPECIFIED", "debug").otherwise(F.lower(word))
    vendor = F.create_map(F.lit("high"), F.lit("low"))
    return table(spark, sf, "orders").select(
        "o_orderkey", normalize_severity(raw).alias("severity"),
        normalize_severity(F.when(word.isin("HIGH", "LOW", "MEDIUM"), raw).otherwise("?"), vendor, "HIGH").alias("custom"),
    )


@query(
    "x5_x6_status_and_flag",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OPEN' ELSE 'ST-' || o_orderstatus END AS status,
  o_orderstatus IN ('O', 'P') AS flag FROM orders""",
)
def statuses(spark, sf):
    s = F.col("o_orderstatus")
    text = F.when(s == "F", "  ").otherwise(F.concat(F.lit(" st-"), F.lower(s), F.lit(" ")))
    flag = F.when(s == "O", " Yes ").when(s == "P", "ENABLED").otherwise("no")
    return table(spark, sf, "orders").select("o_orderkey", normalize_status(text).alias("status"), cast_boolean(flag).alias("flag"))


@query(
    "x7_clean_key",
    "SELECT p_partkey, replace(replace(lower(p_name || '_' || p_brand || '-' || p_type), ' ', ''), '_', '').replace('-', '') AS key FROM part",
)
def keys(spark, sf):
    name = F.concat("p_name", F.lit("_"), "p_brand", F.lit("-"), "p_type")
    return table(spark, sf, "part").select("p_partkey", clean_key(name).alias("key"))


@query("x8_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sha256("text").alias("digest"))


@query(
    "x9_canonical_json",
    """SELECT c_custkey, '{"a":' || CASE WHEN c_nationkey > 12 THEN 'null' ELSE '"' || c_name || '"' END || ',"b\\"":"' || c_mktsegment || '","c":"x\\\\y"}' AS doc FROM customer""",
)
def canonical(spark, sf):
    m = F.create_map(
        F.lit("c"), F.lit("x\\y"), F.lit('b"'), F.col("c_mktsegment"),
        F.lit("a"), F.when(F.col("c_nationkey") <= 12, F.col("c_name")),
    )
    return table(spark, sf, "customer").select("c_custkey", json_map(m).alias("doc"))


@query(
    "x12_x13_tiers",
    """SELECT c_custkey, CASE WHEN v >= 85 THEN 'CRITICAL' WHEN v >= 70 THEN 'HIGH' WHEN v >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN v <= 25 THEN 'LOW' WHEN v <= 50 THEN 'GUARDED' WHEN v <= 75 THEN 'ELEVATED' ELSE 'CRITICAL' END AS tier FROM (SELECT c_custkey, round(abs(c_acctbal) / 100) AS v FROM customer)""",
)
def tiers(spark, sf):
    v = F.round(F.abs("c_acctbal") / 100)
    return table(spark, sf, "customer").select("c_custkey", severity_of_score(v).alias("severity"), risk_tier(v).alias("tier"))


@query(
    "ingest_rows_end_to_end",
    f"""WITH {RAW} SELECT entity_id, count(*) FILTER (WHERE code IS NULL) AS events, count(*) FILTER (WHERE code IS NOT NULL) AS quarantined,
  CAST(sum(event_id) FILTER (WHERE code IS NULL) AS BIGINT) AS row_sum FROM judged GROUP BY 1""",
)
def end_to_end(spark, sf):
    batches = entities(spark, sf).select("entity_id", F.concat(F.lit("S"), "entity_id").alias("submission_id"))
    done = ingest_rows(raw_rows(spark, sf), batches, NOW)
    events = done.events.groupBy("entity_id").agg(F.count("*").alias("events"), F.sum("raw_row_index").alias("row_sum"))
    bad = done.quarantine.groupBy("entity_id").agg(F.count("*").alias("quarantined"))
    return events.join(bad, "entity_id")
