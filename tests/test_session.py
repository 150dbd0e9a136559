"""Intermediate tables and shipping."""

import os
import subprocess
import sys

from askloom.session import checkpoint_root, scope, staged

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scope_deletes_its_tables(spark):
    before = set(os.listdir(checkpoint_root(spark)))
    with scope(spark):
        assert staged(spark.range(5), "numbers").count() == 5
        assert set(os.listdir(checkpoint_root(spark))) != before
    assert set(os.listdir(checkpoint_root(spark))) == before


def test_workers_of_another_folder_get_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from askloom.session import local_session, ship
from askloom.functions.text import normalize_text
from pyspark.sql import functions as F
spark = local_session(1); ship(spark); spark.sparkContext.setLogLevel("OFF")
print("GOT", spark.createDataFrame([("a &amp; b",)], "s string").select(normalize_text(F.col("s"))).first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT a & b" in done.stdout, done.stderr[-2000:]
