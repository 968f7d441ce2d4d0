import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "lantern", tmp_path / "lantern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = e.queries(); assert 'upsert' in names and not any(n.startswith('op1_') or n == 'pipeline' for n in names); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_executors_need_nothing_but_the_package_that_is_sent(tmp_path):
    """From an empty folder, with the repository on the driver's path only through the entry."""
    code = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("composite_anomaly", "fuzzy_copypasta", "html_paragraphs", "greedy_cluster"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(ROOT / "__spark_entry__.py")], cwd=tmp_path, env=env, check=True, timeout=300)
