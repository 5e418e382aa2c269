"""The package reaches the Python workers wherever the driver starts."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name in ("knn_batch", "knn_lsh", "search_text"):
    print(name, e.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_queries_with_python_stages_run_from_any_directory():
    cwd = tempfile.mkdtemp(prefix="vitrine-elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    counts = dict(line.split() for line in res.stdout.strip().splitlines())
    assert int(counts["knn_batch"]) > 0 and int(counts["knn_lsh"]) > 0 and int(counts["search_text"]) > 0
