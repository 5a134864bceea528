"""The star-schema tables read as security telemetry.

Each family maps whole tables to canonical events.  `SQL` holds the same mappings as SQL fragments
for the comparison queries.

* events    -> alerts, investigations, analyst activity, escalations, incidents of 25 entities
* orders    -> cases of the customer's nation; lineitem -> their follow-ups and escalations
* part      -> assets; lineitem -> coverage reports and alerts about them
* documents -> investigation notes, one entity per source
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.execution_gaps import Period
from vigil.schema import event_family

EVENTS_PERIOD = Period(datetime(2024, 1, 1), datetime(2024, 1, 31))
LATE_PERIOD = Period(datetime(2024, 1, 1), datetime(2024, 2, 20))
ORDERS_PERIOD = Period(datetime(1995, 1, 1), datetime(2001, 12, 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(prefix: str, *columns: str) -> Column:
    parts = [F.col(c).cast("string") for c in columns]
    joined = parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)
    return F.concat(F.lit(prefix), joined)


def utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def band(value: str, critical: float, high: float, medium: float) -> Column:
    v = F.col(value)
    return F.when(v >= critical, "CRITICAL").when(v >= high, "HIGH").when(v >= medium, "MEDIUM").otherwise("LOW")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("string").alias("entity_id"),
        F.upper("n_name").alias("entity_code"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("sector"),
        F.concat(F.lit("Tier-"), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("size_tier"),
        F.lit(True).alias("is_active"),
    )


def _events(spark: SparkSession, sf_dir: str, kind: str, by_user: bool) -> DataFrame:
    entity = F.col("user_id") if by_user else F.col("user_id") % 25
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(
        tag("E", "event_id").alias("event_id"),
        F.col("event_id").alias("raw_row_index"),
        F.col("event_id").alias("n"),
        entity.cast("string").alias("entity_id"),
        utc("ts").alias("event_timestamp"),
        tag("U", "user_id").alias("case_id"),
        tag("U", "user_id").alias("user_id"),
        "value", "props",
    )


def alerts(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    df = _events(spark, sf_dir, "error", by_user)
    return event_family(
        df.withColumn("raw_ref_id", tag("A", "n"))
        .withColumn("asset_id", F.replace("case_id", F.lit("U"), F.lit("H")))
        .withColumn("severity", band("value", 70.0, 35.0, 15.0))
        .withColumn("rule_id", F.concat(F.lit("R"), F.get_json_object("props", "$.k")))
        .withColumn("action", F.lit("error")),
        "alert_metadata",
    )


def investigations(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    df = _events(spark, sf_dir, "click", by_user)
    return event_family(
        df.withColumn("raw_ref_id", tag("I", "n"))
        .withColumn("alert_id", F.concat(F.lit("A"), (F.col("n") - 1).cast("string")))
        .withColumn("time_spent_minutes", F.col("value")),
        "investigation_records",
    )


def activity(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    df = _events(spark, sf_dir, "view", by_user)
    return event_family(
        df.withColumn("raw_ref_id", tag("V", "n")).withColumn(
            "alert_id", F.concat(F.lit("A"), (F.col("n") - 1).cast("string"))
        ),
        "analyst_activity",
    )


def escalations(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    df = _events(spark, sf_dir, "signup", by_user)
    target = F.when(F.col("value") >= 35, "TIER_3_IR").when(F.col("value") >= 15, "Incident Manager")
    return event_family(
        df.withColumn("raw_ref_id", tag("S", "n")).withColumn("escalated_to", target.otherwise("TIER_2_DESK")),
        "escalation_records",
    )


def incidents(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    return event_family(
        _events(spark, sf_dir, "purchase", by_user).withColumn("raw_ref_id", tag("P", "n")), "incident_reports"
    )


def purchases_as_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed cases, worked by one analyst per entity."""
    df = _events(spark, sf_dir, "purchase", False)
    return event_family(
        df.withColumn("raw_ref_id", tag("C", "n")).withColumn("status", F.lit("CLOSED"))
        .withColumn("user_id", F.concat(F.lit("N"), F.col("entity_id"))),
        "case_management",
    )


def telemetry(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """All event kinds of the events table."""
    parts = [f(spark, sf_dir, by_user) for f in (alerts, investigations, activity, escalations, incidents)]
    return reduce(DataFrame.unionByName, parts)


def _case_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


STATUS = {"F": "CLOSED", "O": "OPEN", "P": "IN_PROGRESS"}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN")
    priority = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "P1_CRITICAL")
        .when(F.col("o_orderpriority") == "2-HIGH", "P2_HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "P3_MEDIUM")
        .otherwise("P4_LOW")
    )
    return event_family(
        _case_entities(spark, sf_dir).select(
            tag("O", "o_orderkey").alias("event_id"),
            F.col("o_orderkey").alias("raw_row_index"),
            F.col("c_nationkey").cast("string").alias("entity_id"),
            tag("C", "o_orderkey").alias("raw_ref_id"),
            tag("C", "o_orderkey").alias("case_id"),
            tag("Y", "o_custkey").alias("user_id"),
            utc("o_orderdate").alias("event_timestamp"),
            status.otherwise("IN_PROGRESS").alias("status"),
            priority.alias("priority"),
        ),
        "case_management",
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    owner = _case_entities(spark, sf_dir).select("o_orderkey", "c_nationkey")
    return lines.join(owner, lines.l_orderkey == owner.o_orderkey).select(
        F.concat(F.lit("X"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("event_id"),
        F.col("l_linenumber").alias("raw_row_index"),
        F.col("c_nationkey").cast("string").alias("entity_id"),
        tag("C", "l_orderkey").alias("case_id"),
        utc("l_shipdate").alias("event_timestamp"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_tax",
    )


def case_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_family(_lines(spark, sf_dir), "analyst_activity")


def case_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is an escalation: returned ones late or without a delay, accepted ones on time, the others of no case."""
    flag = F.col("l_returnflag")
    late = F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 10)
    return event_family(
        _lines(spark, sf_dir)
        .withColumn("case_id", F.when(flag != "N", F.col("case_id")))
        .withColumn("escalation_delay_minutes", F.when(flag == "R", late).otherwise(F.col("l_quantity")))
        .withColumn("escalation_status", F.when((flag == "R") & (F.col("l_tax") >= 0.08), "BREACHED").otherwise("DONE")),
        "escalation_records",
    )


def case_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("l_returnflag") == "A", "done").when(
        F.col("l_returnflag") == "N", F.concat(F.lit("reviewed "), F.col("l_linestatus"))
    )
    return event_family(_lines(spark, sf_dir).withColumn("investigation_notes", note), "investigation_records")


INVENTORY_TIME = datetime(1995, 1, 1)


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    tier = (
        F.when(size >= 46, "CROWN_JEWEL").when(size >= 41, "CRITICAL").when(size >= 36, "TIER_1")
        .when(size >= 31, "TIER-1").otherwise("STANDARD")
    )
    return event_family(
        table(spark, sf_dir, "part").select(
            tag("P", "p_partkey").alias("event_id"),
            F.col("p_partkey").alias("raw_row_index"),
            (F.col("p_partkey") % 25).cast("string").alias("entity_id"),
            tag("P", "p_partkey").alias("asset_id"),
            tag("P", "p_partkey").alias("raw_ref_id"),
            tag("host-", "p_partkey").alias("hostname"),
            tier.alias("criticality_tier"),
            F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("owner"),
            F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("department"),
            F.lit(INVENTORY_TIME).cast("timestamp").alias("event_timestamp"),
        ),
        "asset_inventory",
    )


def _asset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("X"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("event_id"),
        F.col("l_orderkey").alias("raw_row_index"),
        (F.col("l_partkey") % 25).cast("string").alias("entity_id"),
        F.when(F.col("l_linestatus") == "F", tag("host-", "l_partkey")).otherwise(tag("P", "l_partkey")).alias("asset_id"),
        utc("l_shipdate").alias("event_timestamp"),
        "l_returnflag", "l_quantity", "l_discount", "l_tax",
    )


def asset_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is an alert; those that were not returned are informational."""
    severity = F.when(F.col("l_returnflag") == "R", band("l_quantity", 40.0, 25.0, 10.0)).otherwise("INFORMATIONAL")
    return event_family(
        _asset_lines(spark, sf_dir).withColumn("raw_ref_id", F.col("event_id")).withColumn("severity", severity),
        "alert_metadata",
    )


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage reports: every line, of which those with the highest discount and tax name their asset."""
    named = (F.col("l_discount") >= 0.095) & (F.col("l_tax") >= 0.075)
    df = _asset_lines(spark, sf_dir).withColumn("asset_id", F.when(named, F.col("asset_id")))
    return event_family(df.withColumn("uptime_pct", F.col("l_quantity") * 2.0), "coverage_reports")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_family(
        table(spark, sf_dir, "documents").select(
            tag("D", "doc_id").alias("event_id"),
            F.col("doc_id").alias("raw_row_index"),
            F.col("source").alias("entity_id"),
            tag("D", "doc_id").alias("case_id"),
            F.col("lang").alias("analyst_id"),
            F.lit(INVENTORY_TIME).cast("timestamp").alias("event_timestamp"),
            F.col("text").alias("investigation_notes"),
        ),
        "investigation_records",
    )


# --- the same mappings as SQL ---------------------------------------------------------------------

_EV = """SELECT 'E' || event_id AS event_id, event_id AS n, CAST(user_id % 25 AS VARCHAR) AS entity_id,
  CAST(user_id AS VARCHAR) AS user_entity, ts, 'U' || user_id AS case_id, value, props, event_type
  FROM events"""

SQL = {
    "entities": """entities AS (SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, upper(n_name) AS entity_code,
  n_name AS name, r_name AS sector, 'Tier-' || (n_nationkey % 3 + 1) AS size_tier
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "ev": f"ev AS ({_EV})",
    "alerts": """alerts AS (SELECT event_id, n, entity_id, user_entity, ts, case_id, 'A' || n AS ref, replace(case_id, 'U', 'H') AS asset_id,
  CASE WHEN value >= 70 THEN 'CRITICAL' WHEN value >= 35 THEN 'HIGH' WHEN value >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  'R' || json_extract_string(props, '$.k') AS rule_id FROM ev WHERE event_type = 'error')""",
    "inv": """inv AS (SELECT event_id, n, entity_id, user_entity, ts, case_id, 'I' || n AS ref, 'A' || (n - 1) AS alert_id,
  value AS minutes FROM ev WHERE event_type = 'click')""",
    "act": """act AS (SELECT event_id, n, entity_id, user_entity, ts, case_id, 'V' || n AS ref, 'A' || (n - 1) AS alert_id
  FROM ev WHERE event_type = 'view')""",
    "esc": """esc AS (SELECT event_id, n, entity_id, user_entity, ts, case_id, 'S' || n AS ref,
  CASE WHEN value >= 35 THEN 'TIER_3_IR' WHEN value >= 15 THEN 'Incident Manager' ELSE 'TIER_2_DESK' END AS escalated_to
  FROM ev WHERE event_type = 'signup')""",
    "inc": """inc AS (SELECT event_id, n, entity_id, user_entity, ts, case_id, 'P' || n AS ref FROM ev WHERE event_type = 'purchase')""",
    "cases": """cases AS (SELECT 'O' || o_orderkey AS event_id, o_orderkey AS n, CAST(c_nationkey AS VARCHAR) AS entity_id,
  'C' || o_orderkey AS case_id, 'Y' || o_custkey AS analyst, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'IN_PROGRESS' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'P1_CRITICAL' WHEN '2-HIGH' THEN 'P2_HIGH' WHEN '3-MEDIUM' THEN 'P3_MEDIUM' ELSE 'P4_LOW' END AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "lines": """lines AS (SELECT 'X' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS event_id,
  l_linenumber AS n, CAST(c_nationkey AS VARCHAR) AS entity_id, 'C' || l_orderkey AS case_id, l_shipdate AS ts,
  l_returnflag, l_linestatus, l_quantity, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)""",
    "assets": """assets AS (SELECT 'P' || p_partkey AS event_id, p_partkey AS n, CAST(p_partkey % 25 AS VARCHAR) AS entity_id,
  'P' || p_partkey AS asset_id, 'host-' || p_partkey AS hostname,
  CASE WHEN p_size >= 46 THEN 'CROWN_JEWEL' WHEN p_size >= 41 THEN 'CRITICAL' WHEN p_size >= 36 THEN 'TIER_1'
       WHEN p_size >= 31 THEN 'TIER-1' ELSE 'STANDARD' END AS tier,
  CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS owner, CASE WHEN p_type <> 'SMALL' THEN p_type END AS department
  FROM part)""",
    "asset_lines": """asset_lines AS (SELECT 'X' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS event_id,
  l_orderkey AS n, CAST(l_partkey % 25 AS VARCHAR) AS entity_id,
  CASE WHEN l_linestatus = 'F' THEN 'host-' || l_partkey ELSE 'P' || l_partkey END AS asset_id, l_shipdate AS ts,
  l_returnflag, l_quantity, l_discount, l_tax FROM lineitem)""",
    "asset_alerts": """asset_alerts AS (SELECT *, CASE WHEN l_returnflag <> 'R' THEN 'INFORMATIONAL' WHEN l_quantity >= 40 THEN 'CRITICAL' WHEN l_quantity >= 25 THEN 'HIGH'
  WHEN l_quantity >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM asset_lines)""",
    "coverage": """coverage AS (SELECT * REPLACE (CASE WHEN l_discount >= 0.095 AND l_tax >= 0.075 THEN asset_id END AS asset_id),
  l_quantity * 2.0 AS uptime FROM asset_lines)""",
    "notes": """notes AS (SELECT 'D' || doc_id AS event_id, source AS entity_id, 'D' || doc_id AS case_id, text FROM documents)""",
}
NEEDS = {
    "alerts": ("ev",), "inv": ("ev",), "act": ("ev",), "esc": ("ev",), "inc": ("ev",),
    "asset_alerts": ("asset_lines",), "coverage": ("asset_lines",),
}


def with_sql(*names: str, extra: str = "", body: str, recursive: bool = False) -> str:
    """Assemble a statement from fragments, in dependency order."""
    ordered: list[str] = []
    for name in names:
        for part in (*NEEDS.get(name, ()), name):
            if part not in ordered:
                ordered.append(part)
    parts = [SQL[n] for n in ordered] + ([extra.strip()] if extra.strip() else [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body.strip()
