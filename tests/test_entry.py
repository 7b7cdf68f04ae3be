import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_works_without_the_optional_folder(tmp_path, pipeline_too):
    """The entry imports and its other queries run if foldwright/llm is gone, with
    corpus_pipeline.py or without it."""
    shutil.copytree(ROOT / "foldwright", tmp_path / "foldwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if not pipeline_too:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert len(q) > 100 and not any(n.startswith("op") or n == "pipeline" for n in q)
assert set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert q["auc_members"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180)
