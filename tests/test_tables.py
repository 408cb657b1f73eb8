"""A database that executors of their own open."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

from loomdex.sources import tables

ROOT = Path(__file__).resolve().parents[1]
ROWS = [(1, "a", 0.5), (2, None, None), (3, "", -1e300), (None, 'say "so", é\nthen', 0.1), (5, "  x\\ '", 3.0), (6, '"', 1e-7)]


def test_rows_come_back_from_a_derby_archive(spark):
    df = spark.createDataFrame(ROWS, "k long, s string, d double").repartition(3)
    got = tables.jdbc(spark, tables.derby(df, "t", "k"), '"t"', "k", (1, 7), 4, driver=tables.DERBY)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ROWS, key=str) and got.columns == ["k", "s", "d"]


def test_executors_outside_of_the_driver_read_it(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.executor.memory", "512m").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["jdbc_source"](spark, "/root/testdata/sf0.001").distinct().count())
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 150" in out.stdout, out.stderr[-2000:]
