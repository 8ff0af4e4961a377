import os
import subprocess
import sys
from pathlib import Path

from tabloom.session import local_table, scratch_path, settle, shared_dir

REPO = Path(__file__).resolve().parent.parent


def test_the_configured_folder_is_used(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(configured)


def test_settle(spark):
    few, small = settle(spark.range(3), 3)
    assert small and few.count() == 3
    many, small = settle(spark.range(4), 3)
    assert not small and many.count() == 4


def test_local_table(spark):
    df = local_table(spark, [(1, None, [1, 2]), (2, "b", None)], "k int, s string, a array<bigint>")
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, None, [1, 2]), (2, "b", None)]
    assert local_table(spark, [], "k int").isEmpty()


UNSET = """
from pyspark.sql import SparkSession
from tabloom.session import settle, shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
assert shared_dir(spark) == shared_dir(spark)
assert spark.conf.get("spark.sql.warehouse.dir").split(":")[-1] in shared_dir(spark)
assert settle(spark.range(9), 3)[0].count() == 9
print("settled")
"""


def test_a_session_without_the_setting_uses_its_warehouse(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", UNSET], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "settled" in done.stdout, done.stderr[-2000:]
