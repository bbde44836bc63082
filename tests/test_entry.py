"""The driver's module works whether or not the training-data subpackage is there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), *sorted(q))"


@pytest.mark.parametrize("gone", [("quillon/llm", "tests/llm"), ("quillon/llm", "tests/llm", "corpus_pipeline.py"), ()])
def test_queries_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    there = (copy / "quillon" / "llm").is_dir()
    assert "weekly_sums" in out and ("pipeline" in out) == there == any(x.startswith("op") and "_" in x and x[2].isdigit() for x in out[1:])
