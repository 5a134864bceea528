"""Registered queries against their SQL at the smallest scale.

By default a cross-section runs; VIGIL_ALL_QUERIES=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "eg01_uninvestigated_alerts eg04_closed_without_notes eg07_rapid_closures egg_declarative_rule j1_temporal_not_exists "
    "f03_gt ns01_volume_cliff ns04_closure_deficit a3_inter_arrival c1_burst_clusters w2_burst_clusters_doubling "
    "c5_similar_notes b7_peer_benchmarks v1_v6_quarantined_rows p4_normalized_events s1_delimited_files s7_json_lines "
    "m2_merkle_roots_distributed m4_manifests vw2_worklist w8_report_pick e2_rule_metrics e3_confusion_matrix"
).split()
NAMES = list(entry.queries()) if os.environ.get("VIGIL_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    status, _, _, detail = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "rows-only"), detail


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
