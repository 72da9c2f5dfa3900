"""Executors that don't have this folder on their Python path get the package, for as long as the session runs."""

import os
import subprocess
import sys
import tempfile

import pytest

import __spark_entry__ as entry

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in {names!r}:
    print("rows", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_package_reaches_executors():
    names = [n for n in ("cell_dna_by_city", "op8_language_id") if n in entry.queries()]
    root = os.path.dirname(os.path.abspath(entry.__file__))
    folder = tempfile.mkdtemp(prefix="spark-cluster-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_DIRS": folder}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, shared=f"file://{folder}/shared", names=names)], cwd=folder, env=env, capture_output=True, text=True, timeout=240)
    if "Connection refused" in done.stderr:
        pytest.skip("no local cluster here")
    assert done.returncode == 0 and done.stdout.count("rows ") == len(names) and "rows op8_language_id 0" not in done.stdout, done.stderr[-2000:]
