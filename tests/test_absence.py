"""The package without its optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_training_data_folders(tmp_path, pipeline):
    where = tmp_path / "copy"
    shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json"))
    if not pipeline:
        (where / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=where, check=True, env={**os.environ, "PYTHONPATH": ""})
