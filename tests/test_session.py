"""Sessions: code that reaches executors, and the shared folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from seqseg.session import durable_dir

ROOT = Path(__file__).resolve().parents[1]


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable_dir(spark)
    local = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))
    assert durable_dir(local) == durable_dir(local)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "/shared"), sparkContext=local.sparkContext)
    assert durable_dir(named) == "/shared"


def test_queries_run_from_another_working_folder(tmp_path):
    """Python code in tasks is found although the workers start elsewhere."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("segments_min_length", "peak_prominence"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
