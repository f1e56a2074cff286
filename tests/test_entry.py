"""The entry module in a copy of the repository without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline_stays):
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline_stays else ["corpus_pipeline.py"]))
    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=keep)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(s) < set(q); import bench"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
