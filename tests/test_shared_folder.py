"""Queries whose files executors of their own must find."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])

SCAN = """
import sys
from pyspark.sql import SparkSession
from tessella.plans.registry import QUERIES
conf = {"spark.master": "local-cluster[1,2,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + sys.argv[1]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("rows", QUERIES["sqlite_scan"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_sqlite_scan_by_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")} | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", SCAN, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "rows 25" in done.stdout, done.stderr[-2000:]
