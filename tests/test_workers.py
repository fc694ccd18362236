"""The package works where only the driver knows its folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
assert len(entry.oracle_sql()) >= 48
for name in ("group_similarity", "group_similarity_lang", "density_cluster", "cluster_sizes"):
    assert entry.queries()[name](spark, {SF_DIR!r}).count() > 0
print("all fine")
"""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
def test_other_working_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all fine" in run.stdout, run.stderr[-2000:]
