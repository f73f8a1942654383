"""The driver contract holds with and without the optional subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "apexframe"), copy / "apexframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(os.path.join(ROOT, name), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=env, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 150
