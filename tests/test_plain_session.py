"""The registered queries must run in a session that this package has not built."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ENTRY", e.entry(spark).count())
for name in ("f22_off_hours", "x12_x13_tiers", "ns01_volume_cliff"):
    print("QUERY", name, e.queries()[name](spark, "%s").count())
from vigil.session import RUNTIME_CONF
assert all(spark.conf.isModifiable(k) for k in RUNTIME_CONF)
print("DONE")
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
def test_queries_run_in_a_plain_session():
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", SCRIPT % SF], cwd=root, capture_output=True, text=True, timeout=300)
    assert "DONE" in done.stdout, done.stderr[-2000:]
