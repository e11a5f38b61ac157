"""The shared folder of a session that has none set, and the removal of stored tables."""

import os
import subprocess
import sys

from gristmill.llm.common import discard, stored

PLAIN = """
from pyspark.sql import SparkSession
from gristmill.llm.common import shared_dir, stored
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark) and shared_dir(spark).startswith("file:")
assert stored(spark.range(5), "five").count() == 5
print("fine")
"""


def test_a_session_without_the_key(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd(), "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_discarded_tables_are_gone(spark):
    df = stored(spark.range(5), "five")
    path = df.stored_at.removeprefix("file://")
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)
