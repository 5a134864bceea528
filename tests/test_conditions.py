from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigil.operators.conditions import Condition, all_of, any_of, compile_condition, none_of, where

CASES = [
    (where("severity", "EQ", " critical "), True),
    (where("severity", "NE", "critical"), False),
    (where("score", "EQ", 5), True),
    (where("score", "GT", "4"), True),
    (where("score", "GTE", 5), True),
    (where("score", "LT", 5), False),
    (where("score", "LTE", 5.0), True),
    (where("score", "GT", "abc"), False),
    (where("payload_number", "GT", 9), True),  # text compared as a number
    (where("word", "GT", 3), False),  # neither side comparable
    (where("word", "GT", "alpha"), True),
    (where("severity", "IN", ["high", "CRITICAL"]), True),
    (where("severity", "IN", "CRITICAL"), False),
    (where("severity", "NOT_IN", ["low"]), True),
    (where("severity", "NOT_IN", "low"), True),
    (where("missing", "NOT_IN", ["low"]), False),
    (where("word", "CONTAINS", "ET"), True),
    (where("tags", "CONTAINS", "b"), True),
    (where("tags", "NOT_CONTAINS", "b"), False),
    (where("score", "CONTAINS", "5"), False),
    (where("score", "NOT_CONTAINS", "5"), True),
    (where("word", "STARTS_WITH", "BE"), True),
    (where("word", "ENDS_WITH", "TA"), True),
    (where("word", "REGEX_MATCH", "^B.T"), True),
    (where("missing", "IS_NULL"), True),
    (where("empty", "IS_NULL"), True),
    (where("empty_list", "IS_NULL"), True),
    (where("word", "IS_NOT_NULL"), True),
    (where("word", "LENGTH_LT", 5), True),
    (where("tags", "LENGTH_GT", 2), False),
    (where("score", "LENGTH_LT", 1), True),
    (where("word", "LOWER_IN", [" BETA"]), True),
    (where("word", "LOWER_IN", "beta "), True),
    (where("missing", "EQ", "x"), False),
    (where("missing", "NE", "x"), False),
    (where("normalized_payload.nested.deep", "EQ", "7"), True),
    (where("payload-NUMBER", "EQ", "10"), True),
    (where("seen_at", "LT", datetime(2026, 8, 26)), True),
    (where("event_timestamp", "GTE", datetime(2026, 8, 25)), True),
    (where("event_timestamp", "GTE", "2026"), False),
    (all_of(where("score", "GT", 1), none_of(where("word", "EQ", "x"), where("word", "EQ", "beta"))), False),
    (any_of(where("score", "GT", 100), where("word", "EQ", "BETA")), True),
    (none_of(where("missing", "EQ", "x")), True),
    (Condition(), True),
    (all_of(), True),
    (None, True),
]


@pytest.fixture(scope="module")
def record(spark):
    df = spark.sql("""SELECT 'CRITICAL' AS severity, 5 AS score, 'beta' AS word, array('a', 'b') AS tags, '' AS empty,
      CAST(array() AS array<string>) AS empty_list, CAST(NULL AS string) AS missing, TIMESTAMP '2026-08-25 10:00:00' AS event_timestamp,
      map('payload_number', '10', 'nested', '{"deep": 7}', 'Seen At', '2026-08-25T10:00:00Z') AS normalized_payload""")
    return df


def test_operator_matrix(record):
    columns = [compile_condition(c, record).alias(f"c{i}") for i, (c, _) in enumerate(CASES)]
    row = record.select(*columns).first()
    wrong = [(i, CASES[i], row[i]) for i in range(len(CASES)) if row[i] is not CASES[i][1]]
    assert not wrong


def test_condition_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("severity"), "id").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = df.where(compile_condition(where("id", "GT", 3), df))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan" in plan or "DataFilters" in plan


def test_unknown_operator_is_refused():
    with pytest.raises(ValueError):
        where("a", "LIKE", "b")
