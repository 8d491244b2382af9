"""Queries run where only the driver has the package: what goes to the workers is pickled by value or plain data."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

@F.udf("boolean")
def lacks(_):
    import importlib.util
    return importlib.util.find_spec("scriptorium") is None

assert spark.range(1).select(lacks("id")).first()[0], "the workers have the package"
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").count() > 0
        print("done", name)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": path}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("done op") == 10 and "done pipeline" in done.stdout
