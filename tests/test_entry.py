"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_names_agree(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70
    assert all(callable(f) for f in queries.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "target_fidelity" in df.columns


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_without_the_optional_folders(tmp_path, pipeline_too):
    """Deleting the training-data folders, with or without the pipeline's file, leaves the rest importable and its tests too."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for folder in ("tessera/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    check = "import __spark_entry__ as e; q = e.queries(); assert 'class_profiles' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", check], cwd=copy, capture_output=True, text=True, env=env)
    assert out.returncode == 0, out.stderr
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, env=env)
    assert out.returncode == 0 and "test_scan" in out.stdout, out.stdout + out.stderr
