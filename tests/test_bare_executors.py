"""Executors need no copy of the package: a session started elsewhere, without PYTHONPATH, runs what has Python workers."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = ["ast_functions", "function_chunks", "diff_minimality", "single_file_tests", "webhook_events"]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from codeloom.catalog import QUERIES
for name in sys.argv[2:]:
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print(name, flush=True)
"""


def test_in_an_empty_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), *NAMES], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={"PATH": "/usr/local/bin:/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.stdout.split() == NAMES, done.stderr[-3000:]
