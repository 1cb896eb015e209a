"""The session helper outside the tests' own session."""
import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
from sluice.session import configure, scratch_path
configure(spark)
a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
before = {r[0]: r[1] for r in spark.sql("SET").collect()}
configure(spark)
assert before == {r[0]: r[1] for r in spark.sql("SET").collect()}
spark.range(3).write.parquet(a)
print("fine", spark.read.parquet(a).count())
"""


def test_configure_a_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180, cwd=tmp_path)
    assert "fine 3" in run.stdout, run.stderr[-2000:]
