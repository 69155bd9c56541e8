"""Executors need no copy of the package: functions travel by value."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
q = __spark_entry__.queries()
for name in sys.argv[2:]:
    q[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print(name, flush=True)
"""


@pytest.mark.parametrize("names", [["op1_decontaminate", "op2_toxicity", "op4_simhash", "op5_pii", "op8_suffixes", "op10_quality", "op12_audit", "op13_fim"], ["pipeline"]])
def test_in_an_empty_folder(tmp_path, names):
    """A session started elsewhere, without PYTHONPATH, runs every query that has Python workers."""
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), *names], cwd=tmp_path, capture_output=True, text=True, timeout=900, env={"PATH": "/usr/local/bin:/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.stdout.split() == names, done.stderr[-3000:]
